"""Names, numbers and texts of records as columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record format: dataset numbers, tasks by modality pair (task 5 is not in use), domains.
DATASETS = {"VisualNews": 0, "Fashion200K": 1, "WebQA": 2, "EDIS": 3, "NIGHTS": 4, "OVEN": 5, "INFOSEEK": 6, "FashionIQ": 7, "CIRR": 8, "MSCOCO": 9, "FLICKR30K": 10}
TASKS = {
    "text -> image": 0, "text -> text": 1, "text -> image,text": 2, "image -> text": 3, "image -> image": 4, "image -> text,image": 5,
    "image,text -> text": 6, "image,text -> image": 7, "image,text -> image,text": 8,
}
DOMAINS = {
    "VisualNews": "news", "Fashion200K": "fashion", "WebQA": "wiki", "EDIS": "news", "NIGHTS": "common", "OVEN": "wiki", "INFOSEEK": "wiki",
    "FashionIQ": "fashion", "CIRR": "common", "MSCOCO": "common", "FLICKR30K": "common",
}
#: Pools that exist as test pools only.
TEST_POOLS = ("mscoco_task0", "mscoco_task3", "flickr30k_task0", "flickr30k_task3")
#: What strip() takes away, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def _looked_up(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def dataset_name(number: Column) -> Column:
    return _looked_up(number.cast("int"), {v: k for k, v in DATASETS.items()})


def dataset_id(name: Column) -> Column:
    return _looked_up(name, DATASETS)


def dataset_domain(name: Column) -> Column:
    return _looked_up(name, DOMAINS)


def task_id(query_modality: Column, cand_modality: Column) -> Column:
    """Null for a pair that is no task."""
    return _looked_up(F.concat_ws(" -> ", query_modality, cand_modality), TASKS)


def task_name(number: Column) -> Column:
    return _looked_up(number.cast("int"), {v: k for k, v in TASKS.items()})


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def contains_answer(text: Column, answers: Column) -> Column:
    """Whether any of the answers is in the text; null answers are in none."""
    return F.exists(F.filter(answers, lambda a: a.isNotNull()), lambda a: F.contains(text, a))


def joined_captions(captions: Column) -> Column:
    """The captions that aren't empty, without outer blanks, with a small first letter and without the last full stop, joined by "and"."""
    one = lambda x: F.regexp_replace(F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1)), r"\.$", "")
    return F.array_join(F.transform(F.filter(captions, lambda c: c.isNotNull() & (c != "")), lambda c: one(stripped(c))), " and ")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")


def without_first_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"^[^/]*/", "")


def id_folder(c: Column) -> Column:
    """The first four characters."""
    return F.substring(c, 1, 4)


def path_key(path: Column) -> Column:
    """The last folder and the file's name without its extension."""
    return F.regexp_extract(without_extension(path), r"([^/]*/)?[^/]*$", 0)


def id_digits(c: Column) -> Column:
    """The two characters that stand eight from the end."""
    return F.substring(F.substring(c, -8, 8), 1, 2)


def pool_name(name: Column) -> Column:
    x = F.lower(name)
    return F.when(x.isin(*TEST_POOLS), F.concat(x, F.lit("_test"))).otherwise(x)


def path_pool_name(path: Column) -> Column:
    """The pool that a file name gives: without mbeir_ and _cand_pool.jsonl."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"^mbeir_", ""), r"(_cand_pool)?\.jsonl$", "")


@F.pandas_udf(T.LongType())
def _digest_index(keys: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little") % int(n) for k, n in zip(keys, sizes)], dtype="Int64")


def stable_index(key: Column, size: Column) -> Column:
    """A number under size that depends on the key alone, by an eight-byte BLAKE2b digest."""
    return _digest_index(key, F.when(size > 0, size).otherwise(F.raise_error(F.lit("size must be positive")).cast("int")))


def chosen_prompt(prompts: Column, key: Column) -> Column:
    """The prompt that a key always gets; null without prompts."""
    return F.when(F.size(prompts) > 0, F.element_at(prompts, (stable_index(key, F.greatest(F.size(prompts), F.lit(1))) + 1).cast("int")))


def as_percent(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, c * 100).otherwise(c)


def decimal_percent(c: Column) -> Column:
    """A share as a percentage of two places, half up, as text."""
    return F.round(c.cast("decimal(30,15)") * 100, 2).cast("decimal(20,2)").cast("string")


def parsed_number(c: Column) -> Column:
    """Null for blanks, N/A and what is no number."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("N/A")).try_cast("double")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def caption_list(v: Column, most: int = 5) -> Column:
    """The first captions of a JSON field that is one text or a list of them; empty for null."""
    many = F.try_variant_get(v, "$", "array<string>")
    one = F.try_variant_get(v, "$", "string")
    return F.slice(F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), many), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), 1, most)


def sanitized_svg(c: Column) -> Column:
    """An SVG text without comments, processing instructions, document types and entities, which some readers refuse."""
    x = F.regexp_replace(c, r"(?s)<!--.*?-->|<\?.*?\?>", "")
    return F.regexp_replace(x, r"(?s)<!DOCTYPE[^\[>]*(\[.*?\])?\s*>|<!ENTITY[^>]*>", "")


def flattened(config: dict, prefix: str = "") -> dict[str, object]:
    """A nested configuration as dotted names."""
    out: dict[str, object] = {}
    for k, v in config.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        out |= flattened(v, name) if isinstance(v, dict) else {name: v}
    return out


def configured(config: dict, name: str, default: object = None) -> object:
    """The value of a dotted name, or the default where any part is missing."""
    for part in name.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def ramp(step: Column, warmup: int, length: int) -> Column:
    """0 until warmup, then up to 1 over so many steps."""
    return F.least(F.greatest((step - warmup) / float(max(1, length)), F.lit(0.0)), F.lit(1.0))


def mask_ratio(r: Column) -> Column:
    """The share of positions that stay open after a share r of the steps: the cosine of a quarter turn."""
    return F.cos(F.lit(1.5707963267948966) * r)
