"""Landing layer (A1, A6, A7, A8): CSV scan, crawl-card flattening, crawl stamps
and schema-union appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_landing_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A1: header CSV, every column read as text, '"' as the escape character.

    Values stay strings here and are typed by the cleaning step (C2).  Files with another
    header than the first one are an error, not misread (``enforceSchema`` off).  Large files are
    split; ``multiline=True`` keeps quoted newlines inside one record, a file a task.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8")
    names = reader.csv(path).columns
    return (reader.option("multiLine", multiline).option("enforceSchema", False)
            .schema(StructType([StructField(n, StringType()) for n in names])).csv(path))


#: The column that holds the text of a refused line.
REFUSED = "_refused"


def read_typed_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """A1 with types: header CSV read by ``schema``; a line that does not fit is kept, its text in ``_refused``.

    Of a refused line the fields that do fit have their values, the others are null.  Select other
    columns beside ``_refused``, as the reader only looks for faults in the columns it parses.
    """
    wide = StructType([*schema.fields, StructField(REFUSED, StringType())])
    return (spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE")
            .option("multiLine", multiline).option("columnNameOfCorruptRecord", REFUSED).schema(wide).csv(path))


def refused_lines(scan: DataFrame) -> DataFrame:
    """One row (lines, refused) over a written typed scan."""
    return scan.agg(F.count(F.lit(1)).alias("lines"), F.count(REFUSED).alias("refused"))


def card_body(raw: Column) -> Column:
    """The object under a top-level "card" key when there is one, else the record itself."""
    return F.coalesce(F.get_json_object(raw, "$.card"), raw)


def card_flatten(df: DataFrame, raw_col: str, fields: Sequence[str]) -> DataFrame:
    """One column per requested key of a JSON crawl card.

    Scalars come back as their text; nested objects and lists come back as
    compact JSON text (non-ASCII kept).  Missing keys give null.
    """
    m = F.from_json(card_body(F.col(raw_col)), "map<string,string>")
    return df.select(*[m.getItem(k).alias(k) for k in fields])


def card_keys(df: DataFrame, raw_col: str) -> DataFrame:
    """A6 helper: the distinct keys present in the cards (to pick ``fields``)."""
    m = F.from_json(card_body(F.col(raw_col)), "map<string,string>")
    return df.select(F.explode(F.map_keys(m)).alias("key")).distinct()


def crawl_stamp(df: DataFrame, district_id: int, district_name: str | None) -> DataFrame:
    """crawlDistrictId and crawlDistrictName (the given name, else the record's
    districtName; an empty name counts as missing)."""
    name = F.lit(district_name).cast("string")
    return df.withColumns({
        "crawlDistrictId": F.lit(int(district_id)).cast("bigint"),
        "crawlDistrictName": F.coalesce(F.nullif(name, F.lit("")), F.col("districtName")),
    })


def schema_union_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows then new rows over the sorted union of column names, as text;
    a column missing on one side is ''."""
    cols = sorted(set(old.columns) | set(new.columns))

    def side(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[F.col(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in cols])

    return side(old).unionByName(side(new))
