"""Readers: named projection, schema inference by content, day partitions, text grammars, freshness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import keyword_class, name_key


def json_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """JSON lines with a declared schema; malformed lines give null fields."""
    return spark.read.schema(fields).json(path)


def csv_records(spark: SparkSession, path: str, fields: str, header: bool = True, sep: str = ";") -> DataFrame:
    """Delimited text with a declared schema."""
    return spark.read.schema(fields).csv(path, header=header, sep=sep, mode="PERMISSIVE")


def days(spark: SparkSession, path: str, first: str, last: str, column: str = "day") -> DataFrame:
    """The partitions of [first, last] of a table partitioned by day; missing days give no rows."""
    return spark.read.parquet(path).where(F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def document_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, line_no, line) of plain-text documents, one file a row first (``wholetext``); a line feed at the end begins no line."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "line"))


def renamed(df: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Projection by header: each output column is (header, type); headers match without case, accents or spaces.

    A missing header gives a null column, text that is no such value a null.
    """
    import unicodedata

    def key(s: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        return " ".join(plain.upper().split())

    have = {key(c): c for c in df.columns}
    out = [F.col(f"`{have[key(h)]}`").try_cast(kind).alias(name) if key(h) in have else F.lit(None).cast(kind).alias(name) for name, (h, kind) in wanted.items()]
    return df.select(*out)


def by_content(df: DataFrame, patterns: Mapping[str, str], share: float = 0.5) -> dict[str, str]:
    """Which column holds what: for each name the column whose values match its pattern most often, above ``share``.

    One aggregation of a hit rate per column and pattern; a column serves one name, patterns
    choose in order.
    """
    rates = [F.avg(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")).rlike(p), F.lit(False)).cast("int")).alias(f"{n}|{i}") for n, p in patterns.items() for i, c in enumerate(df.columns)]
    got = df.agg(*rates).first().asDict()
    out: dict[str, str] = {}
    for n in patterns:
        free = [(-(got[f"{n}|{i}"] or 0), i) for i, c in enumerate(df.columns) if c not in out.values()]
        if free and -min(free)[0] > share:
            out[n] = df.columns[min(free)[1]]
    return out


def best_parse(parses: Mapping[str, DataFrame], valid: Column) -> tuple[str, DataFrame]:
    """The (name, rows) of the parse with most valid rows; the first of equals."""
    counts = {name: df.where(valid).count() for name, df in parses.items()}
    name = max(counts, key=lambda k: counts[k])
    return name, parses[name]


#: Fixed rules: what a document is, by its words.
DOCUMENT_TYPES = {"manifest": r"\b(MANIFEST|ROMANEIO)\b", "schedule": r"\b(SCHEDULE|ESCALA)\b", "report": r"\b(REPORT|RELATORIO)\b"}


def document_type(text: Column) -> Column:
    """The first type whose words the text holds, else ``unknown``."""
    return keyword_class(text, DOCUMENT_TYPES, "unknown")


def changes(messages: DataFrame, text: str) -> DataFrame:
    """Change requests in short messages: one row per segment with plate, kind and store number.

    Segments are split at line breaks and semicolons. A plate is LLLNxNN; the first verb decides
    the kind: swap, cancel or add.
    """
    seg = F.explode(F.split(name_key(F.regexp_replace(text, r"[\n;]", "|")), r"\|"))
    rows = messages.select("*", seg.alias("segment")).where(F.trim("segment") != "")
    plate = F.regexp_replace(F.regexp_extract("segment", r"\b([A-Z]{3}-?[0-9][A-Z0-9][0-9]{2})\b", 1), "-", "")
    kind = keyword_class(F.col("segment"), {"swap": r"\b(SWAP|TROCA|REPLACE)", "cancel": r"\b(CANCEL|REMOVE)", "add": r"\b(ADD|INCLU)"})
    number = F.regexp_extract("segment", r"\b(?:STORE|LOJA)\s*([0-9]{1,3})\b", 1)
    return rows.select("*", F.when(plate != "", plate).alias("plate"), kind.alias("kind"), F.when(number != "", number.cast("int")).alias("store"))


def fresh(df: DataFrame, written: str, day: str, now: Column, today: Column, minutes_today: int = 4, minutes_past: int = 360) -> DataFrame:
    """Cache rows that still hold: written within minutes (today's) or hours (past days').

    An entry of a past day that was written before that day had ended is stale.
    """
    age = (now - F.col(written)) / 60
    ended = F.col(written) >= (F.col(day) + 1) * 86_400
    return df.where(F.when(F.col(day) == today, age <= minutes_today).otherwise((age <= minutes_past) & ended))


def blocks(lines: DataFrame, doc: list[str], order: str, line: str, heads: Mapping[str, str], item: str, fields: Mapping[str, int]) -> DataFrame:
    """Item lines of text documents with what the header lines above them say: ``doc``, ``order``, the heads and the item's fields.

    ``heads``: name to pattern with one group. A line of the first head begins a block; the other
    heads hold until the block ends. Items before any block belong to none and go; ``fields``
    names groups of ``item``. Spaces in lines count once.
    """
    from pyspark.sql import Window

    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    rows = lines.select(*doc, order, text.alias("_text"))
    first = next(iter(heads))
    rows = rows.withColumns({f"_{n}": F.when(F.col("_text").rlike(p), F.regexp_extract("_text", p, 1)) for n, p in heads.items()})
    block = F.sum(F.col(f"_{first}").isNotNull().cast("int")).over(Window.partitionBy(*doc).orderBy(order))
    rows = rows.withColumn("_block", block)
    inside = Window.partitionBy(*doc, "_block").orderBy(order)
    rows = rows.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(inside) for n in heads})
    found = rows.where((F.col("_block") > 0) & F.col("_text").rlike(item))
    return found.select(*doc, order, *heads, *[F.regexp_extract("_text", item, g).alias(n) for n, g in fields.items()])


def street_and_number(address: Column) -> dict[str, Column]:
    """street, number and what follows it; without exactly one comma and a number after it, all is street."""
    plain = F.trim(F.regexp_replace(address, r"\s+", " "))
    pattern = r"^([^,]*),\s*([0-9]+)\s*(.*)$"
    fits = plain.rlike(pattern) & (F.length(F.regexp_replace(plain, "[^,]", "")) == 1)
    part = lambda g: F.trim(F.regexp_extract(plain, pattern, g))
    return {"street": F.when(fits, part(1)).otherwise(plain), "number": F.when(fits, part(2)).otherwise(""), "rest": F.when(fits, part(3)).otherwise("")}
