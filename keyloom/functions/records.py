"""Fields of the entry and candidate tables as columns; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\p{Z}\p{C}]+"


def parsed_json(c: Column) -> Column:
    """The variant of a JSON text; null where it is null or broken. A JSON string that holds JSON is parsed once more."""
    once = F.try_parse_json(c)
    inner = F.try_variant_get(once, "$", "string")
    return F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(inner)).otherwise(once)


def json_text(c: Column, *names: str) -> Column:
    """The first of the named string fields that the JSON object has; null where there is none or the JSON is broken."""
    v = parsed_json(c)
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))


def entity_key(c: Column) -> Column:
    """An entity id as in Q123: without blanks, case and the prefix wd:; null where nothing is left."""
    x = F.upper(F.regexp_replace(c, _BLANKS, ""))
    return F.nullif(F.regexp_replace(x, "^WD:", ""), F.lit(""))


def split_name(c: Column) -> Column:
    """train, val or test of any usual spelling; null for anything else."""
    x = F.lower(F.regexp_replace(c, _BLANKS, ""))
    return (
        F.when(x.isin("train", "training"), "train")
        .when(x.isin("val", "valid", "validation", "dev"), "val")
        .when(x.isin("test", "testing"), "test")
    )


def file_split(c: Column) -> Column:
    """The split that the folder in query_file gives."""
    return split_name(F.regexp_extract(c, r"(?:^|/)(train|val|test)/[^/]*$", 1))


def file_dataset(c: Column) -> Column:
    """The dataset that the file name in query_file gives."""
    return F.nullif(F.regexp_extract(c, r"(?:^|/)mbeir_([^/]*?)_(?:train|val|test)\.jsonl$", 1), F.lit(""))


def image_key(c: Column) -> Column:
    """The image that a path names: its file name without folders, escapes, separators, blanks, case and extension; '' for none."""
    x = F.coalesce(F.try_url_decode(c), c)
    x = F.coalesce(F.try_url_decode(x), x)
    x = F.regexp_replace(x, _BLANKS, "")
    x = F.element_at(F.split(F.regexp_replace(x, r"[\\/]+$", ""), r"[\\/]"), -1)
    x = F.regexp_replace(x, r"(?<=.)\.[A-Za-z]{2,5}$", "")
    return F.coalesce(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), F.lit(""))
