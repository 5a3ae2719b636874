"""One query text, two engines: the few words in which Spark SQL and the checking engine differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SPARK = {
    "r": "r",
    "g": "",
    "like": "regexp_like",
    "lines": r"(SELECT doc_id, source, CAST(p AS BIGINT) AS ln, line FROM documents LATERAL VIEW posexplode(split(text, r'\n')) x AS p, line)",
    "words": r"(SELECT doc_id, CAST(p AS BIGINT) AS wn, word FROM documents LATERAL VIEW posexplode(filter(split(lower(text), r'[ \n\t\r]+'), w -> w <> '')) x AS p, word)",
    "agg": lambda value, sep, order: f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), z -> z.v), {sep})",
    "dot": lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)",
    "sha": lambda x: f"sha2(encode({x}, 'UTF-8'), 256)",
    "all": lambda x, p: f"regexp_extract_all({x}, {p}, 1)",
}
CHECK = {
    "r": "",
    "g": ", 'g'",
    "like": "regexp_matches",
    "lines": "(SELECT doc_id, source, i AS ln, s[i + 1] AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents), unnest(range(len(s))) u(i))",
    "words": r"(SELECT doc_id, i AS wn, s[i + 1] AS word FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \n\t\r]+'), lambda w: w <> '') AS s FROM documents), unnest(range(len(s))) u(i))",
    "agg": lambda value, sep, order: f"string_agg({value}, {sep} ORDER BY {order})",
    "dot": lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))",
    "sha": lambda x: f"sha256({x})",
    "all": lambda x, p: f"regexp_extract_all({x}, {p}, 1)",
}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def both(write: Callable[[dict], str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(Spark query, SQL of the checking engine) of one writer."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = write(SPARK)
        views(spark, sf_dir, text)
        return spark.sql(text)

    return query, write(CHECK)
