"""Rows of a Spark result and of its SQL twin in one comparable form."""


def value(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(value, v)) + "]"
    return repr(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(value(r[i]) for i in order) for r in rows)


def assert_same(df, cursor):
    names = [d[0] for d in cursor.description]
    rows = df.collect()
    assert canonical([tuple(r) for r in rows], df.columns) == canonical(cursor.fetchall(), names)
    return len(rows)


def shuffled(df):
    """Names of the columns that the exchanges of a DataFrame's plan move."""
    import re

    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return {re.sub("#.*", "", c.strip()) for x in re.findall(r"\) Exchange\s+Input \[\d+\]: \[([^\]]*)\]", text) for c in x.split(",")}
