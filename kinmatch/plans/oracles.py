"""The registered queries as plain SQL, for checking results in another engine.

The statements are put together from named ``WITH`` steps.  ``Sql`` collects
the steps; each helper adds those it needs and names the result.
"""

from __future__ import annotations

from ..operators.cosine import ADDRESS, GRID, NAME
from .people import INPUT_SQL, MASTER_SQL
from .specs import SPECS

# Fixed values, written out once more, so that a wrong one in the library shows up.
UNITS = "APT|APARTMENT|UNIT|TRLR|TRAILER|LOT|BLDG|BUILDING|STE|SUITE|FLOOR|FL|RM|ROOM|SPACE|SPC|#"
BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNIT_PATTERN = rf"(?i){BLANK}({UNITS}){BLANK}+([A-Z0-9]+)"
UNIT_PATTERNS = {
    "loose": (rf"(?i)(?:{UNITS})\s*([A-Z0-9]+)", 0, 1),
    "word_boundary": (rf"(?i)\b(?:{UNITS})\s*([A-Z0-9]+)", 0, 1),
    "blank_before": (rf"(?i)\s(?:{UNITS})\s*([A-Z0-9]+)", 0, 1),
    "blank_both_sides": (rf"(?i)\s({UNITS})\s+([A-Z0-9]+)", 1, 2),
}
MATCH_ABBREVIATIONS = (
    (" STREET", " ST"), (" ROAD", " RD"), (" AVENUE", " AVE"), (" LANE", " LN"), (" DRIVE", " DR"), (" COURT", " CT"), (" PLACE", " PL"),
)
AUDIT_ABBREVIATIONS = (("ROAD", "RD"), ("STREET", "ST"), ("AVENUE", "AVE"), ("LANE", "LN"))
LEVELS = (100, 95, 90, 85, 80, 75, 70)
LOWER_THRESHOLDS = {"FullName": 70.0, "LastNameAddress": 60.0, "FullAddress": 65.0}

STANDARD = ("First_Name", "Last_Name", "Address1", "City", "State", "Zip")


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def fold(c: str) -> str:
    return strip(f"upper(coalesce(CAST({c} AS VARCHAR), ''))")


def tokens(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')))"


def replaced(c: str, pairs) -> str:
    for old, new in pairs:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def digits(a: str) -> str:
    return f"nullif(regexp_extract({strip(a)}, '^(\\d+)', 1), '')"


def house(a: str) -> str:
    return f"TRY_CAST({digits(a)} AS BIGINT)"


def street(a: str) -> str:
    return strip(f"string_split(regexp_replace({strip(a)}, '^\\d+\\s*', ''), ',')[1]")


def unit_piece(a: str, group: int) -> str:
    return f"regexp_extract({a}, '{UNIT_PATTERN}', {group})"


def unit_label(a: str) -> str:
    return f"trim(concat({unit_piece(a, 1)}, ' ', {unit_piece(a, 2)}))"


def display_name(first: str, last: str) -> str:
    return strip(f"concat({first}, ' ', {last})")


def word(c: str, at: int) -> str:
    return f"coalesce(string_split_regex({strip(c)}, '\\s+')[{at}], '')"


def piece(a: str, at: int) -> str:
    return f"CASE WHEN len(string_split({a}, ',')) >= {-at} THEN {strip(f'string_split({a}, chr(44))[{at}]')} ELSE '' END"


class Sql:
    def __init__(self):
        self.steps: dict[str, str] = {}

    def add(self, name: str, body: str) -> str:
        self.steps.setdefault(name, body)
        return name

    def query(self, body: str) -> str:
        steps = ",\n".join(f"{n} AS ({b})" for n, b in self.steps.items())
        return f"WITH {steps}\n{body}" if steps else body

    # --- tables

    def raw(self, side: str) -> str:
        sql = INPUT_SQL if side == "input" else MASTER_SQL
        return self.add(f"raw_{side}", sql.format(customer="customer", supplier="supplier"))

    def standard(self, side: str) -> str:
        raw = self.raw(side)
        renamed = {c: c for c in STANDARD}
        if side == "master":
            renamed = dict(zip(STANDARD, ("FirstName", "LastName", '"_line"', "City", "State", "Zip5")))
            raw = self.add(
                "raw_master_line",
                f"""SELECT *, concat(coalesce(Address, ''), ' ', {strip("coalesce(\"Address 2\", '')")}) AS "_line" FROM {raw}""",
            )
        columns = ", ".join(f"{fold(source)} AS {c}" for c, source in renamed.items())
        plain = self.add(f"plain_{side}", f"SELECT row_id, {columns} FROM {raw}")
        return self.add(
            side, f"SELECT *, trim(concat(Address1, ', ', City, ', ', State, ' ', Zip), ', ') AS FullAddress FROM {plain}"
        )

    def partners(self) -> str:
        """Every input row next to the master row it was derived from."""
        return self.add(
            "partners",
            f"""SELECT i.row_id AS pair_id, i.FullAddress AS a, m.FullAddress AS b,
 {display_name('i.First_Name', 'i.Last_Name')} AS name_a, {display_name('m.First_Name', 'm.Last_Name')} AS name_b
 FROM {self.standard('input')} i JOIN {self.standard('master')} m ON m.row_id = i.row_id * 15 + i.row_id % 15""",
        )

    # --- scores of string pairs (p, q)

    def lcs(self, name: str, pairs: str) -> str:
        chars = self.add(
            f"{name}_chars",
            f"SELECT x, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) AS pos "
            f"FROM (SELECT DISTINCT x FROM {pairs} WHERE x <> '')",
        )
        masks = self.add(
            f"{name}_masks",
            f"""SELECT x, map_from_entries(list(struct_pack(k := ch, v := m))) AS masks, (CAST(1 AS HUGEINT) << length(x)) - 1 AS w
 FROM (SELECT x, ch, CAST(sum(CAST(1 AS HUGEINT) << (pos - 1)) AS HUGEINT) AS m FROM {chars} GROUP BY x, ch) GROUP BY x""",
        )
        return self.add(
            name,
            f"""SELECT s.x, s.y, CASE WHEN s.x = '' OR s.y = '' THEN 0 ELSE length(s.x) - bit_count(list_reduce(
 list_prepend(w, list_transform(string_split(s.y, ''), lambda c: coalesce(map_extract_value(masks, c), CAST(0 AS HUGEINT)))),
 lambda u, m: ((u + (u & m)) | (u - (u & m))) & w)) END AS n
 FROM (SELECT DISTINCT x, y FROM {pairs}) s LEFT JOIN {masks} k ON k.x = s.x""",
        )

    def ratio(self, name: str, pairs: str) -> str:
        """(p, q, score) of the plain ratio for the distinct pairs of a table with columns p, q."""
        xy = self.add(f"{name}_xy", f"SELECT DISTINCT p AS x, q AS y FROM {pairs} WHERE p IS NOT NULL AND q IS NOT NULL")
        lcs = self.lcs(f"{name}_lcs", xy)
        return self.add(
            name,
            f"""SELECT x AS p, y AS q, CASE WHEN length(x) + length(y) = 0 THEN 1e2
 ELSE 1e2 - 1e2 * (length(x) + length(y) - 2 * n) / (length(x) + length(y)) END AS score FROM {lcs}""",
        )

    def partial(self, name: str, pairs: str) -> str:
        """(p, q, score) of the best window; strings must not be empty."""
        both = self.add(
            f"{name}_both",
            f"""SELECT DISTINCT p, q, p AS s, q AS t FROM {pairs} WHERE length(p) <= length(q)
 UNION SELECT DISTINCT p, q, q, p FROM {pairs} WHERE length(q) <= length(p)""",
        )
        windows = self.add(
            f"{name}_windows",
            f"""SELECT p AS p0, q AS q0, s AS p, substr(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) AS q
 FROM (SELECT *, unnest(range(1 - length(s), length(t))) AS i FROM {both})""",
        )
        scores = self.ratio(f"{name}_ratio", windows)
        return self.add(
            name,
            f"SELECT p0 AS p, q0 AS q, max(score) AS score FROM {windows} w JOIN {scores} r ON r.p = w.p AND r.q = w.q GROUP BY p0, q0",
        )

    def weighted(self, name: str, pairs: str) -> str:
        """(p, q, score) of the weighted score; strings must not be empty."""
        sorted_ = "array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')), ' ')"
        shaped = self.add(
            f"{name}_shaped",
            f"""SELECT p, q, greatest(length(p), length(q)) / CAST(least(length(p), length(q)) AS DOUBLE) AS apart,
 list_has_any({tokens('p')}, {tokens('q')}) AS share, {sorted_.format(c='p')} AS sp, {sorted_.format(c='q')} AS sq,
 array_to_string({tokens('p')}, ' ') AS kp, array_to_string({tokens('q')}, ' ') AS kq FROM (SELECT DISTINCT p, q FROM {pairs})""",
        )

        def step(kind, columns, where):
            return self.add(f"{name}_{kind}_pairs", f"SELECT DISTINCT {columns} FROM {shaped} WHERE {where}")

        r = self.ratio(f"{name}_r", shaped)
        t = self.token_set(f"{name}_t", step("t", "p, q", "apart < 1.5"))
        o = self.ratio(f"{name}_o", step("o", "sp AS p, sq AS q", "apart < 1.5"))
        n = self.partial(f"{name}_n", step("n", "p, q", "apart >= 1.5"))
        no = self.partial(f"{name}_no", step("no", "sp AS p, sq AS q", "apart >= 1.5 AND NOT share"))
        nk = self.partial(f"{name}_nk", step("nk", "kp AS p, kq AS q", "apart >= 1.5 AND NOT share"))
        scale = "CASE WHEN apart <= 8 THEN 9e-1 ELSE 6e-1 END"
        return self.add(
            name,
            f"""SELECT s.p, s.q, CASE WHEN apart < 1.5 THEN greatest(r.score, greatest(o.score, t.score) * 95e-2)
 ELSE greatest(r.score, n.score * {scale}, CASE WHEN share THEN 1e2 ELSE greatest(no.score, nk.score) END * 95e-2 * {scale}) END AS score
 FROM {shaped} s JOIN {r} r ON r.p = s.p AND r.q = s.q LEFT JOIN {t} t ON t.p = s.p AND t.q = s.q
 LEFT JOIN {o} o ON o.p = s.sp AND o.q = s.sq LEFT JOIN {n} n ON n.p = s.p AND n.q = s.q
 LEFT JOIN {no} no ON no.p = s.sp AND no.q = s.sq LEFT JOIN {nk} nk ON nk.p = s.kp AND nk.q = s.kq""",
        )

    def token_set(self, name: str, pairs: str) -> str:
        lists = self.add(
            f"{name}_lists",
            f"SELECT p, q, {tokens('p')} AS tp, {tokens('q')} AS tq FROM (SELECT DISTINCT p, q FROM {pairs} WHERE p IS NOT NULL AND q IS NOT NULL)",
        )
        return self.token_set_of_lists(name, lists, "p, q")

    def token_set_of_lists(self, name: str, lists: str, keys: str) -> str:
        rest = self.add(
            f"{name}_rest",
            f"""SELECT {keys}, len(tp) AS np, len(tq) AS nq,
 coalesce(array_to_string(list_filter(tp, lambda t: NOT list_contains(tq, t)), ' '), '') AS x,
 coalesce(array_to_string(list_filter(tq, lambda t: NOT list_contains(tp, t)), ' '), '') AS y,
 length(coalesce(array_to_string(list_filter(tp, lambda t: list_contains(tq, t)), ' '), '')) AS s FROM {lists}""",
        )
        lcs = self.lcs(f"{name}_lcs", rest)
        return self.add(
            name,
            f"""SELECT {keys}, CASE WHEN np = 0 OR nq = 0 THEN 0e0 WHEN s > 0 AND (x = '' OR y = '') THEN 1e2
 WHEN s = 0 THEN 1e2 - 1e2 * (lx + ly - 2 * n) / (lx + ly)
 ELSE greatest(1e2 - 1e2 * (lx + ly - 2 * n) / (2 * s + 2 + lx + ly), 1e2 - 1e2 * (1 + lx) / (2 * s + 1 + lx), 1e2 - 1e2 * (1 + ly) / (2 * s + 1 + ly)) END AS score
 FROM (SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, np, nq, r.x, r.y, s, n, length(r.x) AS lx, length(r.y) AS ly
       FROM {rest} r JOIN {lcs} l ON l.x = r.x AND l.y = r.y)""",
        )

    def address(self, name: str, pairs: str) -> str:
        """(p, q, score) of the address rules."""
        parts = self.add(
            f"{name}_parts",
            f"""SELECT p, q, {house('p')} AS hp, {house('q')} AS hq,
 upper({unit_piece('p', 1)}) AS tp, upper({unit_piece('p', 2)}) AS np, upper({unit_piece('q', 1)}) AS tq, upper({unit_piece('q', 2)}) AS nq,
 {replaced(street('p'), MATCH_ABBREVIATIONS)} AS sp, {replaced(street('q'), MATCH_ABBREVIATIONS)} AS sq
 FROM (SELECT DISTINCT p, q FROM {pairs} WHERE p IS NOT NULL AND q IS NOT NULL)""",
        )
        streets = self.add(f"{name}_streets", f"SELECT sp AS p, sq AS q FROM {parts}")
        whole, all_, near = self.ratio(f"{name}_ratio", parts), self.token_set(f"{name}_set", parts), self.token_set(
            f"{name}_street", streets
        )
        return self.add(
            name,
            f"""SELECT t.p, t.q, CASE WHEN hp IS NULL OR hq IS NULL THEN s.score
 WHEN hp = hq AND (tp <> tq OR np <> nq) THEN 0e0
 WHEN hp = hq AND n.score < 78 THEN least(w.score * 7e-1, 65e0)
 WHEN hp = hq THEN w.score
 WHEN abs(hp - hq) <= 2 THEN least(s.score * 8e-1, 85e0)
 WHEN abs(hp - hq) <= 10 THEN least(s.score * 5e-1, 60e0)
 ELSE least(s.score * 2e-1, 30e0) END AS score
 FROM {parts} t JOIN {whole} w ON w.p = t.p AND w.q = t.q JOIN {all_} s ON s.p = t.p AND s.q = t.q
 JOIN {near} n ON n.p = t.sp AND n.q = t.sq""",
        )

    # --- matching

    def search(self, side: str, types) -> str:
        table = self.standard(side)
        parts = []
        for t in types:
            columns = SPECS[t].search
            joined = strip(f"concat_ws(' ', {', '.join(columns)})") if len(columns) > 1 else columns[0]
            parts.append(f"SELECT '{t}' AS kind, row_id AS id, {joined} AS search, {tokens(joined)} AS toks FROM {table}")
        return self.add(f"search_{side}", " UNION ALL ".join(parts))

    def pair_scores(self, types) -> str:
        """Token-set score of every pair of distinct token lists."""
        a, b = self.search("input", types), self.search("master", types)
        keys = self.add(
            "key_pairs",
            f"""SELECT a.kind, a.toks AS tp, b.toks AS tq FROM (SELECT DISTINCT kind, toks FROM {a}) a
 JOIN (SELECT DISTINCT kind, toks FROM {b}) b ON a.kind = b.kind""",
        )
        return self.token_set_of_lists("key_scores", keys, "kind, tp, tq")

    def top_k(self, types, cutoffs: dict[str, float], k: int = 10) -> str:
        a, b, scores = self.search("input", types), self.search("master", types), self.pair_scores(types)
        case = " ".join(f"WHEN '{t}' THEN {float(cutoffs[t])!r}" for t in types)
        return self.add(
            "top_k",
            f"""SELECT * FROM (SELECT a.kind AS match_type, a.id AS a_id, b.id AS b_id, s.score AS stage1,
 row_number() OVER (PARTITION BY a.kind, a.id ORDER BY s.score DESC, b.id) AS rank
 FROM {a} a JOIN {scores} s ON s.kind = a.kind AND s.tp = a.toks JOIN {b} b ON b.kind = s.kind AND b.toks = s.tq
 WHERE s.score >= CASE a.kind {case} END) WHERE rank <= {k}""",
        )

    def candidates(self, types=tuple(SPECS), thresholds=None) -> str:
        thresholds = {t: (thresholds or {}).get(t, SPECS[t].threshold) for t in types}
        top = self.top_k(types, {t: 0.8 * x for t, x in thresholds.items()})
        pairs = self.add(
            "cand_pairs",
            f"""SELECT c.*, a.First_Name AS fa, b.First_Name AS fb, a.Last_Name AS la, b.Last_Name AS lb,
 a.FullAddress AS address_a, b.FullAddress AS address_b FROM {top} c
 JOIN {self.standard('input')} a ON a.row_id = c.a_id JOIN {self.standard('master')} b ON b.row_id = c.b_id""",
        )
        first = self.token_set("first_score", self.add("first_pairs", f"SELECT fa AS p, fb AS q FROM {pairs}"))
        last = self.token_set("last_score", self.add("last_pairs", f"SELECT la AS p, lb AS q FROM {pairs}"))
        address = self.address("address_score", self.add("addr_pairs", f"SELECT address_a AS p, address_b AS q FROM {pairs}"))
        return self.add(
            "scored",
            f"""SELECT c.*, CASE match_type
 WHEN 'FullName' THEN CASE WHEN f.score > 0 AND l.score > 0 THEN (f.score + l.score) / 2 ELSE 0e0 END
 WHEN 'LastNameAddress' THEN CASE WHEN l.score > 0 AND d.score > 0 THEN (l.score + d.score) / 2 ELSE 0e0 END
 ELSE d.score END AS score
 FROM {pairs} c JOIN {first} f ON f.p = fa AND f.q = fb JOIN {last} l ON l.p = la AND l.q = lb
 JOIN {address} d ON d.p = address_a AND d.q = address_b""",
        )

    def results_of(self, name: str, best: str) -> str:
        return self.add(
            name,
            f"""SELECT match_type, round_even(score, 2) AS match_score, a_id + 2 AS a_row, b_id + 2 AS b_row,
 {display_name('fa', 'la')} AS name_a, {display_name('fb', 'lb')} AS name_b, address_a, address_b FROM {best}""",
        )

    def results(self, types=tuple(SPECS), thresholds=None) -> str:
        scored = self.candidates(types, thresholds)
        case = " ".join(f"WHEN '{t}' THEN {float((thresholds or {}).get(t, SPECS[t].threshold))!r}" for t in types)
        best = self.add(
            "best",
            f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_type, a_id ORDER BY score DESC, rank) AS place FROM {scored} WHERE score > 0)
 WHERE place = 1 AND score >= CASE match_type {case} END""",
        )
        return self.results_of("results", best)

    def sweep(self) -> str:
        scored = self.candidates(thresholds=LOWER_THRESHOLDS)
        levels = ", ".join(f"('{t}', {x!r})" for t in SPECS for x in (SPECS[t].threshold, LOWER_THRESHOLDS[t]))
        level = self.add("levels", f"SELECT * FROM (VALUES {levels}) v(kind, threshold)")
        return self.add(
            "swept",
            f"""SELECT * FROM (SELECT s.*, threshold, row_number() OVER (PARTITION BY match_type, a_id, threshold ORDER BY score DESC, rank) AS place
 FROM {scored} s JOIN {level} v ON v.kind = s.match_type WHERE score > 0 AND stage1 >= 8e-1 * threshold)
 WHERE place = 1 AND score >= threshold""",
        )

    # --- reports

    def findings(self, rules: str) -> str:
        r = self.add(
            "parts",
            f"""SELECT *, {house('address_a')} AS house_a, {house('address_b')} AS house_b,
 {street('address_a')} AS street_a, {street('address_b')} AS street_b,
 {unit_label('address_a')} AS unit_a, {unit_label('address_b')} AS unit_b,
 {piece('address_a', -3)} AS piece_a, {piece('address_b', -3)} AS piece_b,
 {word('name_a', 1)} AS first_a, {word('name_b', 1)} AS first_b, {word('name_a', -1)} AS last_a, {word('name_b', -1)} AS last_b
 FROM {self.results()}""",
        )

        def rule(problem, part, where, source=r):
            return (
                f"SELECT match_type, '{problem}' AS problem, match_score AS score, a_row, b_row, "
                f"CAST({part}_a AS VARCHAR) AS part_a, CAST({part}_b AS VARCHAR) AS part_b FROM {source} WHERE {where}"
            )

        def unrelated(p):
            return f"({p}_a <> {p}_b AND NOT contains({p}_a, {p}_b) AND NOT contains({p}_b, {p}_a))"

        same_house = "house_a = house_b AND house_a <> 0"
        types_differ = "unit_a <> '' AND unit_b <> '' AND string_split(unit_a, ' ')[1] <> string_split(unit_b, ' ')[1]"
        if rules == "first":
            parts = [
                rule("same_house_diff_street", "street", f"{same_house} AND street_a <> street_b AND match_score > 70"),
                rule("diff_property_types", "unit", f"{types_differ} AND match_score > 50"),
                rule("diff_house_numbers", "house", "house_a <> 0 AND house_b <> 0 AND abs(house_a - house_b) > 50 AND match_score > 70"),
                rule("diff_cities", "piece", "piece_a <> piece_b AND match_score > 60"),
            ]
        else:
            short = self.add(
                "short_streets",
                f"SELECT *, {replaced('upper(street_a)', AUDIT_ABBREVIATIONS)} AS p, {replaced('upper(street_b)', AUDIT_ABBREVIATIONS)} AS q FROM {r}",
            )
            ratio = self.ratio("street_ratio", short)
            near = self.add("street_rated", f"SELECT s.*, t.score AS street_score FROM {short} s JOIN {ratio} t ON t.p = s.p AND t.q = s.q")
            parts = [
                rule("completely_diff_names", "name", f"match_type = 'FullName' AND match_score > 80 AND {unrelated('first')} AND {unrelated('last')}"),
                rule(
                    "diff_streets_same_house",
                    "street",
                    f"match_type = 'FullAddress' AND {same_house} AND street_a <> street_b AND match_score > 80 AND p <> q AND street_score <= 85",
                    near,
                ),
                rule("diff_property_types", "unit", f"match_type = 'FullAddress' AND {types_differ} AND match_score > 20"),
                rule("diff_last_names", "last", f"match_type = 'LastNameAddress' AND match_score > 80 AND {unrelated('last')}"),
            ]
        return self.add("findings", " UNION ALL ".join(parts))

    def types(self) -> str:
        return self.add("types", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in SPECS)}) v(match_type)")

    def cosine(self, pairs: str, a: str, b: str, configs) -> str:
        parts = []
        for c in configs:
            for side, column in ((0, a), (1, b)):
                for n in range(c.smallest, c.largest + 1):
                    text = f"lower({column})"
                    if c.analyzer == "char":
                        text = f"regexp_replace({text}, '\\s\\s+', ' ', 'g')"
                        grams = f"list_transform(range(1, length({text}) - {n} + 2), lambda i: substr({text}, i, {n}))"
                    else:
                        words = f"regexp_extract_all({text}, '\\b\\w\\w+\\b')"
                        grams = f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"
                    parts.append(
                        f"SELECT pair_id, '{c.name}' AS config, {side} AS side, unnest({grams}) AS gram FROM {pairs} WHERE {a} <> '' AND {b} <> ''"
                    )
        grams = self.add("grams", " UNION ALL ".join(parts))
        counts = self.add(
            "gram_counts",
            f"SELECT pair_id, config, gram, count(*) FILTER (WHERE side = 0) AS n_a, count(*) FILTER (WHERE side = 1) AS n_b FROM {grams} GROUP BY ALL",
        )
        sub = ", ".join(f"'{c.name}'" for c in configs if c.sublinear) or "''"

        def weight(n):
            return f"CASE WHEN {n} = 0 THEN 0e0 WHEN config IN ({sub}) THEN (1 + ln({n})) * idf ELSE {n} * idf END"

        weights = self.add(
            "gram_weights",
            f"""SELECT pair_id, config, {weight('n_a')} AS w_a, {weight('n_b')} AS w_b
 FROM (SELECT *, CASE WHEN n_a > 0 AND n_b > 0 THEN 1e0 ELSE ln(15e-1) + 1 END AS idf FROM {counts})""",
        )
        sums = self.add(
            "gram_sums",
            f"SELECT pair_id, config, sum(w_a * w_b) AS dot, sqrt(sum(w_a * w_a)) * sqrt(sum(w_b * w_b)) AS norm FROM {weights} GROUP BY ALL",
        )
        names = ", ".join(f"('{c.name}')" for c in configs)
        return self.query(
            f"""SELECT p.pair_id, v.config, coalesce(round_even(CASE WHEN norm > 0 THEN 1e2 * dot / norm ELSE 0e0 END, 2), 0e0) AS cosine
 FROM {pairs} p CROSS JOIN (VALUES {names}) v(config) LEFT JOIN {sums} s ON s.pair_id = p.pair_id AND s.config = v.config"""
        )


RESULT = "SELECT match_type, match_score, a_row, b_row, name_a, name_b, address_a, address_b FROM results"


def _results(types=tuple(SPECS), thresholds=None) -> str:
    s = Sql()
    s.results(types, thresholds)
    return s.query(RESULT)


def _top_k(t: str) -> str:
    s = Sql()
    top = s.top_k((t,), {t: 0.8 * SPECS[t].threshold})
    return s.query(f"SELECT match_type, a_id, b_id, round_even(stage1, 2) AS stage1, rank FROM {top}")


def oracle_statements() -> dict[str, str]:
    out: dict[str, str] = {}

    s = Sql()
    both = " UNION ALL ".join(
        f"SELECT '{side}' AS side, row_id, {', '.join(STANDARD)}, FullAddress FROM {s.standard(side)}" for side in ("input", "master")
    )
    out["standardize"] = s.query(both)

    s = Sql()
    parts = []
    for side in ("input", "master"):
        t = s.standard(side)
        for spec in SPECS.values():
            joined = strip(f"concat_ws(' ', {', '.join(spec.search)})") if len(spec.search) > 1 else spec.search[0]
            parts.append(f"SELECT '{side}' AS side, '{spec.name}' AS match_type, row_id, {joined} AS search FROM {t}")
    out["search_strings"] = s.query(" UNION ALL ".join(parts))

    s = Sql()
    a, name = "FullAddress", display_name("First_Name", "Last_Name")
    parts = [
        f"""SELECT '{side}' AS side, row_id, {house(a)} AS house, {street(a)} AS street, upper({unit_piece(a, 1)}) AS unit_type,
 upper({unit_piece(a, 2)}) AS unit_number, {replaced(street(a), MATCH_ABBREVIATIONS)} AS short_street,
 {replaced(f'upper({street(a)})', AUDIT_ABBREVIATIONS)} AS audit_street,
 {piece(a, -3)} AS third_last, {piece(a, -2)} AS city, {name} AS display_name, {word(name, 1)} AS first_word, {word(name, -1)} AS last_word
 FROM {s.standard(side)}"""
        for side in ("input", "master")
    ]
    out["address_parts"] = s.query(" UNION ALL ".join(parts))

    for key, t in (("full_name", "FullName"), ("last_name_address", "LastNameAddress"), ("full_address", "FullAddress")):
        out[f"top_k_{key}"] = _top_k(t)
        out[f"match_{key}"] = _results((t,))
    out["match_all"] = _results()
    out["match_full_address_any_score"] = _results(("FullAddress",), {"FullAddress": 0.0})

    s = Sql()
    pairs = s.add("pairs", f"SELECT pair_id, a AS p, b AS q FROM {s.partners()}")
    sorted_ = "array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')), ' ')"
    sorts = s.add("sorted_pairs", f"SELECT DISTINCT p AS a, q AS b, {sorted_.format(c='p')} AS p, {sorted_.format(c='q')} AS q FROM {pairs}")
    r, t, o, d = s.ratio("r", pairs), s.token_set("t", pairs), s.ratio("o", sorts), s.address("d", pairs)
    n, w = s.partial("n", pairs), s.weighted("w", pairs)
    columns = ("r ratio", "n partial", "o token_sort", "t token_set", "w weighted", "d address")
    picked = ", ".join(f"round_even({x.split()[0]}.score, 2) AS {x.split()[1]}_score" for x in columns)
    out["score_pairs"] = s.query(
        f"""SELECT pair_id, x.p AS a, x.q AS b, {picked}
 FROM {pairs} x JOIN {r} r ON r.p = x.p AND r.q = x.q JOIN {t} t ON t.p = x.p AND t.q = x.q JOIN {n} n ON n.p = x.p AND n.q = x.q
 JOIN {sorts} z ON z.a = x.p AND z.b = x.q JOIN {o} o ON o.p = z.p AND o.q = z.q
 JOIN {d} d ON d.p = x.p AND d.q = x.q JOIN {w} w ON w.p = x.p AND w.q = x.q"""
    )

    s = Sql()
    res = s.results()
    out["unmatched"] = s.query(
        f"""SELECT row_id + 2 AS Original_Row_Number, * EXCLUDE (row_id) FROM {s.raw('input')}
 WHERE row_id + 2 NOT IN (SELECT a_row FROM {res})"""
    )
    s = Sql()
    res, inp = s.results(), s.standard("input")
    labelled = f"(SELECT match_type, a_row FROM {res} UNION ALL SELECT 'ALL', a_row FROM {res})"
    out["coverage"] = s.query(
        f"""SELECT t.match_type, n AS input_rows, count(a_row) AS results, count(DISTINCT a_row) AS matched, n - count(DISTINCT a_row) AS unmatched,
 round(1e2 * (n - count(DISTINCT a_row)) / n, 1) AS unmatched_pct
 FROM (SELECT match_type FROM {s.types()} UNION ALL SELECT 'ALL') t LEFT JOIN {labelled} r ON r.match_type = t.match_type
 CROSS JOIN (SELECT count(*) AS n FROM {inp}) GROUP BY t.match_type, n"""
    )
    s = Sql()
    res, inp = s.results(), s.standard("input")
    out["unmatched_samples"] = s.query(
        f"""SELECT * FROM (SELECT t.match_type, row_number() OVER (PARTITION BY t.match_type ORDER BY row_id) AS place, row_id + 2 AS a_row,
 {display_name('First_Name', 'Last_Name')} AS name, FullAddress AS address
 FROM {inp} CROSS JOIN {s.types()} t WHERE NOT EXISTS (SELECT 1 FROM {res} r WHERE r.match_type = t.match_type AND r.a_row = row_id + 2)) WHERE place <= 3"""
    )
    s = Sql()
    res = s.results()
    out["score_summary"] = s.query(
        f"""SELECT t.match_type, count(match_score) AS matches, min(match_score) AS min_score, max(match_score) AS max_score,
 round(avg(match_score), 2) AS avg_score FROM {s.types()} t LEFT JOIN {res} r ON r.match_type = t.match_type GROUP BY t.match_type"""
    )
    s = Sql()
    res = s.results()
    levels = ", ".join(f"({x})" for x in LEVELS)
    out["score_distribution"] = s.query(
        f"""SELECT match_type, level, count(*) FILTER (WHERE match_score >= level) AS matches,
 round(1e2 * count(*) FILTER (WHERE match_score >= level) / count(*), 1) AS pct
 FROM {res} CROSS JOIN (VALUES {levels}) v(level) GROUP BY match_type, level"""
    )
    s = Sql()
    out["below_perfect"] = s.query(
        f"SELECT match_type, count(*) FILTER (WHERE match_score < 100) AS below_100 FROM {s.results()} GROUP BY match_type"
    )
    s = Sql()
    out["lowest_matches"] = s.query(f"SELECT * FROM {s.results()} ORDER BY match_score, a_row, match_type LIMIT 5")

    for name, rules in (("audit_first", "first"), ("audit_revised", "revised")):
        s = Sql()
        out[name] = s.query(f"SELECT * FROM {s.findings(rules)}")
        s = Sql()
        found, res = s.findings(rules), s.results()
        out[f"{name}_summary"] = s.query(
            f"""SELECT t.match_type, m AS matches, p AS problems, CASE WHEN m > 0 THEN round(1e2 * (m - p) / m, 1) ELSE 0e0 END AS success_rate
 FROM (SELECT match_type, (SELECT count(*) FROM {res} r WHERE r.match_type = t.match_type) AS m,
 (SELECT count(*) FROM {found} f WHERE f.match_type = t.match_type) AS p FROM {s.types()} t) t"""
        )
    s = Sql()
    out["problem_counts"] = s.query(f"SELECT match_type, problem, count(*) AS cases FROM {s.findings('first')} GROUP BY ALL")
    s = Sql()
    out["problem_samples"] = s.query(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_type, problem ORDER BY score DESC, a_row) AS place
 FROM {s.findings('first')}) WHERE place <= 3"""
    )

    s = Sql()
    swept = s.sweep()
    current = " ".join(f"WHEN '{t}' THEN {x.threshold!r}" for t, x in SPECS.items())
    lower = " ".join(f"WHEN '{t}' THEN {x!r}" for t, x in LOWER_THRESHOLDS.items())
    out["threshold_sweep"] = s.query(
        f"""SELECT match_type, c::DOUBLE AS current_threshold, l::DOUBLE AS lower_threshold, n AS at_current, m AS at_lower, m - n AS gained
 FROM (SELECT match_type, c, l, (SELECT count(*) FROM {swept} s WHERE s.match_type = t.match_type AND s.threshold = c) AS n,
 (SELECT count(*) FROM {swept} s WHERE s.match_type = t.match_type AND s.threshold = l) AS m
 FROM (SELECT match_type, CASE match_type {current} END AS c, CASE match_type {lower} END AS l FROM {s.types()}) t)"""
    )
    s = Sql()
    swept = s.sweep()
    low = s.add("low", f"SELECT * FROM {swept} WHERE threshold = CASE match_type {lower} END")
    res = s.results_of("low_results", low)
    out["gained_examples"] = s.query(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_type ORDER BY match_score, a_row) AS place FROM {res})
 WHERE place <= 3 AND match_score < CASE match_type {current} END"""
    )

    label = "CASE WHEN pair_id % 10 IN (5, 6, 8, 9) THEN 'BAD' ELSE 'GOOD' END"
    s = Sql()
    pairs = s.add("pairs", f"SELECT pair_id, a AS p, b AS q, {label} AS label FROM {s.partners()}")
    scored = s.token_set("t", pairs)
    out["calibrate_threshold"] = s.query(
        f"""SELECT round_even(g, 2) AS min_good, round_even(b, 2) AS max_bad, round_even((g + b) / 2, 2) AS suggested
 FROM (SELECT min(score) FILTER (WHERE label = 'GOOD') AS g, max(score) FILTER (WHERE label = 'BAD') AS b
 FROM {pairs} x JOIN {scored} t ON t.p = x.p AND t.q = x.q)"""
    )
    s = Sql()
    kind = "CASE WHEN pair_id % 10 IN (5, 6, 8) THEN 'FIXED' WHEN pair_id % 10 = 9 THEN 'LOW' WHEN pair_id % 10 = 7 THEN 'DIFFERENT' WHEN pair_id % 10 IN (2, 3) THEN 'PRESERVE' ELSE 'HIGH' END"
    pairs = s.add("pairs", f"SELECT pair_id, a AS p, b AS q, {kind} AS label FROM {s.partners()}")
    scored = s.address("d", pairs)
    ok = "CASE label WHEN 'FIXED' THEN score <= 65 WHEN 'DIFFERENT' THEN score <= 70 WHEN 'LOW' THEN score <= 60 ELSE score >= 85 END"
    out["check_expectations"] = s.query(
        f"""SELECT label, count(*) FILTER (WHERE {ok}) AS passed, count(*) FILTER (WHERE NOT {ok}) AS failed
 FROM {pairs} x JOIN {scored} t ON t.p = x.p AND t.q = x.q GROUP BY label"""
    )

    def diff(s: Sql) -> str:
        i, m = s.standard("input"), s.standard("master")
        columns = sorted((*STANDARD, "FullAddress"))
        changed = ", ".join(f"CASE WHEN i.{c} IS DISTINCT FROM m.{c} THEN '{c}' END" for c in columns)
        return s.add(
            "diff",
            f"""SELECT row_id, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side, concat_ws(',', {changed}) AS changed
 FROM (SELECT coalesce(i.row_id, m.row_id) AS row_id, i, m FROM {i} i FULL JOIN {m} m ON m.row_id = i.row_id) z,
 LATERAL (SELECT z.i.row_id AS k) l, LATERAL (SELECT z.m.row_id AS k) r
 WHERE side <> 'both' OR changed <> ''""",
        )

    types = ("FullName", "FullAddress", "LastNameAddress")
    order = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(types))
    found = f"""s.score > 85 AND s.score < 99.99 ORDER BY a.id, b.id, CASE a.kind {order} END"""
    columns = "a.id + 2 AS a_row, b.id + 2 AS b_row, a.kind AS match_type, round_even(s.score, 2) AS score"
    for name, limit in (("near_matches_token_set", 1), ("near_match_examples", 20)):
        s = Sql()
        scores, a, b = s.pair_scores(types), s.search("input", types), s.search("master", types)
        out[name] = s.query(
            f"""SELECT {columns} FROM {a} a JOIN {scores} s ON s.kind = a.kind AND s.tp = a.toks
 JOIN {b} b ON b.kind = s.kind AND b.toks = s.tq WHERE {found} LIMIT {limit}"""
        )
    s = Sql()
    a, b = s.search("input", types), s.search("master", types)
    pairs = s.add(
        "string_pairs",
        f"""SELECT p, q FROM (SELECT DISTINCT kind, search AS p FROM {a} WHERE search <> '') a
 JOIN (SELECT DISTINCT kind, search AS q FROM {b} WHERE search <> '') b ON a.kind = b.kind""",
    )
    scores = s.weighted("w", pairs)
    out["near_matches"] = s.query(
        f"""SELECT {columns} FROM {a} a JOIN {b} b ON b.kind = a.kind JOIN {scores} s ON s.p = a.search AND s.q = b.search
 WHERE {found} LIMIT 1"""
    )

    s = Sql()
    out["diff_tables"] = s.query(f"SELECT * FROM {diff(s)}")
    s = Sql()
    out["diff_summary"] = s.query(
        f"SELECT count(*) = 0 AS is_identical, count(*) AS different_rows, min(row_id) AS first_different_row FROM {diff(s)}"
    )
    s = Sql()
    columns = {
        "input": ("row_id", "First_Name", "Last_Name", "Address1", "City", "State", "Zip", "First_Name_CB"),
        "master": ("row_id", "FirstName", "LastName", "Address", "Address 2", "City", "State", "Zip5"),
    }
    parts = []
    for side, names in columns.items():
        values = ", ".join(f"({i}, '{n}', '{'string' if i else 'bigint'}')" for i, n in enumerate(names))
        parts.append(
            f"SELECT '{side}' AS table_name, (SELECT count(*) FROM {s.raw(side)}) AS row_count, position, column_name, type FROM (VALUES {values}) v(position, column_name, type)"
        )
    out["profile_tables"] = s.query(" UNION ALL ".join(parts))
    s = Sql()
    out["row_counts"] = s.query(
        " UNION ALL ".join(f"SELECT '{side}' AS table_name, count(*) AS rows FROM {s.standard(side)}" for side in ("input", "master"))
    )
    s = Sql()
    out["first_rows"] = s.query(
        f"SELECT * FROM (SELECT row_id, {', '.join(STANDARD)}, FullAddress FROM {s.standard('master')} ORDER BY row_id LIMIT 5)"
    )
    s = Sql()
    i, m = s.raw("input"), s.raw("master")
    out["choose_roles"] = s.query(
        f"""SELECT CASE WHEN i > m THEN 'master' ELSE 'input' END AS input_table, CASE WHEN i > m THEN 'input' ELSE 'master' END AS master_table,
 least(i, m) AS input_rows, greatest(i, m) AS master_rows FROM (SELECT (SELECT count(*) FROM {i}) AS i, (SELECT count(*) FROM {m}) AS m)"""
    )
    s = Sql()
    parts = [
        f"""SELECT row_id, FullAddress AS address, '{name}' AS pattern, regexp_extract(FullAddress, '{regex}', 0) AS found,
 {f"regexp_extract(FullAddress, '{regex}', {kind})" if kind else "''"} AS unit_type, regexp_extract(FullAddress, '{regex}', {number}) AS unit_number
 FROM {s.standard('master')}"""
        for name, (regex, kind, number) in UNIT_PATTERNS.items()
    ]
    out["unit_patterns"] = s.query(" UNION ALL ".join(parts))

    given = (
        "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
        "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
    )
    counted = [f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in given]
    out["table_set"] = " UNION ALL ".join(counted)
    out["table_set_by_prefix"] = " UNION ALL ".join(c for c in counted if "'c" in c)
    out["row_ids"] = "SELECT row_number() OVER () - 1 AS row_id, c_custkey FROM customer"
    out["unicode_parts"] = "SELECT c_custkey, c_custkey AS house, CAST(c_nationkey AS VARCHAR) AS unit_number FROM customer"

    s = Sql()
    out["cosine_address"] = s.cosine(s.partners(), "a", "b", (ADDRESS,))
    s = Sql()
    out["cosine_name"] = s.cosine(s.partners(), "name_a", "name_b", (NAME,))
    s = Sql()
    out["cosine_grid"] = s.cosine(s.partners(), "a", "b", GRID)
    return out
