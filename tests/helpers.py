"""Small entries tables."""

SCHEMA = (
    "entry_id long, project string, file string, pos int, entry_type string, key_raw string, key string, fields map<string,string>, "
    "n_fields int, is_commented boolean, raw string, modified_at timestamp, ingested_at timestamp"
)


def entries(spark, rows):
    """Rows of ``(id, file, key, fields)`` or dicts with any column; the rest is filled in."""
    out = []
    for n, r in enumerate(rows):
        r = r if isinstance(r, dict) else dict(zip(("entry_id", "file", "key_raw", "fields", "modified_at"), r))
        fields = r.get("fields")
        row = {
            "entry_id": n + 1, "project": "p", "file": "a.bib", "pos": n, "entry_type": "article", "key_raw": None, "fields": fields,
            "n_fields": None if fields is None else len(fields) + 2, "is_commented": False, "raw": None, "modified_at": None, "ingested_at": None,
        } | r
        row.setdefault("key", row["key_raw"] or None)
        out.append(tuple(row[c.split()[0]] for c in SCHEMA.replace("map<string,string>", "map<>").split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def one_column(spark, values, f, name="v"):
    """Results of a Column function over values, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["out"] for r in df.select("i", f(F.col(name)).alias("out")).orderBy("i").collect()]
