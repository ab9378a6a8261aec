"""Small frames of documents and pages for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """Documents 0, 1, ... of the texts; other columns by name, one value for all or a list."""
    rows = []
    for n, text in enumerate(texts):
        def value(name, default):
            v = columns.get(name, default)
            return v[n] if isinstance(v, list) else v

        rows.append((value("doc_id", n) if "doc_id" in columns else n, text, value("lang", "en"), value("source", "s"), len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) != 1 else r[1] for r in df.select(df.columns[0], *columns).collect()}


def sql_rows(sql, tables):
    """Rows of a SQL check over frames, as sorted dicts."""
    import duckdb

    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name, df.toArrow())
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=repr_of)


def spark_rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr_of)


def repr_of(row):
    return repr(sorted(row.items()))
