"""What several test modules share, apart from fixtures."""

RECORD = "row_id long, First_Name string, Last_Name string, Address1 string, City string, State string, Zip string"


def rows(df, *columns):
    """Sorted plain tuples of a DataFrame."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
