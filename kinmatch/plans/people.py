"""People tables derived from the star schema: a master list and an input list.

The driver's tables hold no names or addresses, so names, streets and cities
are picked by key from fixed lists.  Input row ``j`` is a variation of master
row ``15 j + j % 15``; the variation depends on ``j % 10``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lists the fixture draws from.
FIRST = "MARIA|JOHN|HANNAH|WILLIAM|PHILLIP|ANNE|MICHELLE|OSCAR|ELLEN|GRETA|TOBIAS|NORA|ALLISON|PETER|RUTH|CONRAD|BELLA|DENNIS|IRIS|MATTHEW"
LAST = "ABBOTT|BRENNER|CALLOWAY|DELLUCCI|EMMETT|FARROW|GALLAGHER|HOLLIS|IVERSEN|JENNINGS|KELLER|LOMBARD|MARLOWE|NORTON|OKAFOR|PELLETIER|QUILL|RENNICK|SADLER|TILLMAN|UPTON|VILLARD|WESCOTT|XANDER|YARROW|ZELLER|ASHBY|BIRCH|COLLIER|DRUMMOND|ELLSWORTH|FENWICK|GRANGER|HALLORAN|INGRAM|JESSUP|KNOWLES"
STREET = "ALDER STREET|BIRCH ROAD|CEDAR AVENUE|DOVE LANE|ELM DRIVE|FOX HILL ROAD|GLEN COURT|HAZEL PLACE|IRON ST|JUNIPER RD|KESTREL AVE|LARCH LN|MILL POND DR|NORTH CT|OAK PL|PINE ST|QUARRY RD|RIVER ST|SPRUCE LN|THISTLE DR|UNION ST|VALLEY RD|WILLOW AVE"
CITY = "PORTVALE|EASTMERE|NORTH DALE|LAKE ORRIN|STONEBRIDGE|FAIRWICK|GRANTON"

_PARTS = f"""
 split_part('{FIRST}','|',CAST(c_custkey%20+1 AS INT)) AS f,
 split_part('{LAST}','|',CAST(c_custkey%37+1 AS INT)) AS l,
 c_custkey%83+1 AS h,
 split_part('{STREET}','|',CAST(c_custkey%23+1 AS INT)) AS st,
 CASE WHEN c_custkey%9=0 THEN concat('Apt ',CAST(c_custkey%12+1 AS VARCHAR(9)))
      WHEN c_custkey%9=1 THEN concat('Unit ',CAST(c_custkey%12+1 AS VARCHAR(9)))
      WHEN c_custkey%9=2 THEN concat('Lot ',CAST(c_custkey%5+1 AS VARCHAR(9))) END AS u,
 split_part('{CITY}','|',CAST(c_nationkey%7+1 AS INT)) AS c,
 CASE WHEN c_nationkey%5=0 THEN 'FL' WHEN c_nationkey%5=1 THEN 'NY' ELSE 'CT' END AS s,
 CASE WHEN c_nationkey%5=0 THEN concat('34',CAST(100+c_nationkey AS VARCHAR(9)))
      ELSE concat('06',CAST(300+c_nationkey AS VARCHAR(9))) END AS z"""

MASTER_SQL = f"""
SELECT c_custkey AS row_id, f AS FirstName, l AS LastName, concat(CAST(h AS VARCHAR(9)),' ',st) AS Address,
 u AS "Address 2", c AS City, s AS State, z AS Zip5
FROM (SELECT c_custkey, {_PARTS} FROM {{customer}}) m"""

INPUT_SQL = f"""
SELECT j AS row_id,
 CASE WHEN v=1 THEN substr(f,1,length(f)-1) WHEN v=9 THEN 'ZZYX' WHEN v=2 THEN lower(f) ELSE f END AS First_Name,
 CASE WHEN v=9 THEN 'QWORTZ' WHEN v=1 THEN replace(l,'LL','L') WHEN v=3 THEN concat('  ',l,' ') ELSE l END AS Last_Name,
 CASE WHEN v=9 THEN 'RURAL BOX' ELSE concat(CAST(CASE WHEN v=5 THEN h+1 WHEN v=6 THEN h+7 WHEN v=8 THEN h+40 ELSE h END AS VARCHAR(9)),' ',
   CASE WHEN v=2 THEN replace(replace(replace(st,' ROAD',' RD'),' STREET',' ST'),' AVENUE',' AVE')
        WHEN v=0 AND j%20=10 THEN replace(replace(st,'E','A'),'I','O') ELSE st END,
   CASE WHEN u IS NULL THEN '' WHEN v=7 THEN concat(' ',replace(u,'Apt','Unit')) ELSE concat(' ',u) END) END AS Address1,
 c AS City, s AS State,
 CASE WHEN j%50=17 THEN NULL WHEN v=3 THEN substr(z,2,4) WHEN v=4 THEN concat(z,'-1234') ELSE z END AS Zip,
 'x' AS First_Name_CB
FROM (SELECT s_suppkey AS j, s_suppkey%10 AS v, {_PARTS}
 FROM {{supplier}} JOIN {{customer}} ON c_custkey = s_suppkey*15 + s_suppkey%15) i"""


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = MASTER_SQL.replace('"Address 2"', "`Address 2`")
    return spark.sql(sql.format(customer=_table(sf_dir, "customer")))


def people_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INPUT_SQL.format(customer=_table(sf_dir, "customer"), supplier=_table(sf_dir, "supplier")))
