"""Profiling: per-field statistics, the schema, and recommendations drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.predicate import column
from tessera.plans.model import BOOLEAN, DATE, DATE_PATTERN, NESTED, NULL, NUMBER, STRING, Field, FieldStats, Schema, physical_kind

CARDINALITY_CAP = 10_000
SAMPLES = 5
HEAD_ROWS = 1000

#: Parts of names that speak against and for an index.
SKIP_NAMES = ("_uri", "_url", "_id", "uri", "url", "href", "link", "hash", "token", "secret", "key", "description", "text", "content", "body")
ALLOW_NAMES = ("category", "type", "status", "state", "level", "color", "lang", "rarity", "set", "frame")


def _value(df: DataFrame, name: str):
    """What makes values of a field distinct."""
    kind, c = df.schema[name].dataType, column(name)
    if physical_kind(kind) == NESTED:
        return F.to_json(c)
    return c + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else c  # -0.0 is 0.0


def field_stats(df: DataFrame, ordinal: str | None = None, cap: int | None = CARDINALITY_CAP, samples: bool = True) -> tuple[int, dict[str, tuple[str, FieldStats]]]:
    """(rows, field -> (logical type, stats)).

    One pass takes nulls, bounds, date checks and approximate distinct counts. Only fields whose count
    can lie below the cap are counted exactly, in a second pass whose state the cap bounds. Samples, the
    first distinct values in reading order, come from the head where it holds enough of them.
    """
    names = [c for c in df.columns if c != ordinal]
    kinds = {n: physical_kind(df.schema[n].dataType) for n in names}
    aggs = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        c = column(n)
        aggs += [F.count_if(c.isNull()).alias(f"null{i}"), F.approx_count_distinct(_value(df, n), 0.02).alias(f"about{i}")]
        if kinds[n] in (NUMBER, STRING, DATE):
            aggs += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
        if kinds[n] == STRING:
            valid = c.rlike(DATE_PATTERN) & F.try_to_timestamp(c).isNotNull()
            aggs.append(F.count_if(valid).alias(f"dates{i}"))
    row = df.agg(*aggs).collect()[0].asDict()
    rows = row["rows"]
    exact = [i for i in range(len(names)) if cap is None or row[f"about{i}"] <= 1.2 * cap]
    # Sets are bounded by the cap; counting all fields' values in one aggregate would expand every row for each field.
    distinct = F.count_distinct if cap is None else lambda c: F.size(F.collect_set(c))
    counted = df.agg(*[distinct(_value(df, names[i])).alias(f"n{i}") for i in exact]).collect()[0].asDict() if exact else {}
    out = {}
    for i, n in enumerate(names):
        kind = kinds[n]
        if row[f"null{i}"] == rows:
            kind = NULL
        elif kind == STRING and row[f"dates{i}"] == rows - row[f"null{i}"]:
            kind = DATE
        elif kind == NESTED:
            kind = STRING
        cardinality = counted.get(f"n{i}", cap or 0)
        out[n] = kind, FieldStats(min(cardinality, cap) if cap else cardinality, row[f"null{i}"], row.get(f"min{i}"), row.get(f"max{i}"))
    if samples and rows:
        _add_samples(df, ordinal, names, {n: s for n, (_, s) in out.items()})
    return rows, out


def _add_samples(df: DataFrame, ordinal: str | None, names: list[str], stats: dict[str, FieldStats]) -> None:
    ordered = df.orderBy(column(ordinal)) if ordinal else df
    head = ordered.limit(HEAD_ROWS).collect()
    for n in names:
        seen = dict.fromkeys(str(r[n]) if isinstance(r[n], (list, dict, tuple)) else r[n] for r in head if r[n] is not None)
        if len(seen) >= min(SAMPLES, stats[n].cardinality):
            stats[n].samples = list(seen)[:SAMPLES]
        else:
            stats[n].samples = [r["value"] for r in first_values(df, n, ordinal).collect()]


def first_values(df: DataFrame, name: str, ordinal: str | None, n: int = SAMPLES) -> DataFrame:
    """``value, first``: the first ``n`` distinct non-null values in reading order."""
    at = column(ordinal) if ordinal else F.monotonically_increasing_id()
    return df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(F.min(at).alias("first")).orderBy("first").limit(n)


def stats_frame(df: DataFrame) -> DataFrame:
    """``field, cardinality, null_count, min_text, max_text`` of every field."""
    _, stats = field_stats(df, samples=False)
    rows = [(n, s.cardinality, s.null_count, None if s.min is None else str(s.min), None if s.max is None else str(s.max)) for n, (_, s) in stats.items()]
    return df.sparkSession.createDataFrame(rows, "field string, cardinality bigint, null_count bigint, min_text string, max_text string")


def key_name(name: str) -> bool:
    return "id" in name.lower() or name.lower() == "key"


def find_primary(rows: int, fields: list[Field]) -> str | None:
    """The first field that is unique and complete and is named like a key, as far as its values are counted."""
    for f in fields:
        if rows and key_name(f.name) and f.stats.cardinality == rows and f.stats.null_count == 0:
            return f.name
    return None


def find_whole_primary(df: DataFrame, rows: int, fields: list[Field], cap: int | None) -> str | None:
    """The same for any number of rows: fields with more values than the cap counts are tested for repeated ones."""
    if cap is None or rows <= cap:
        return find_primary(rows, fields)
    for f in fields:
        # Beyond the cap there are more rows than counted values: a field below it repeats some.
        if key_name(f.name) and f.stats.null_count == 0 and f.stats.cardinality >= cap:
            if df.groupBy(_value(df, f.name).alias("value")).count().where("count > 1").isEmpty():
                return f.name
    return None


def worth_index(f: Field, rows: int) -> bool:
    distinct, name = f.stats.cardinality, f.name.lower()
    if distinct <= 1 or distinct > rows * 0.5 or distinct > 1000:
        return False
    texts = [str(s) for s in f.stats.samples]
    if any("[object " in t or "://" in t or len(t) > 100 for t in texts):
        return False
    if any(s in name for s in SKIP_NAMES) and not any(a in name for a in ALLOW_NAMES):
        return False
    return distinct >= 2 if f.type == BOOLEAN else 2 <= distinct <= 500


def infer_schema(df: DataFrame, ordinal: str | None = None, order: list[str] | None = None, cap: int | None = CARDINALITY_CAP, primary: str | None = None, whole: bool = False) -> tuple[int, Schema]:
    """(rows, schema): primary first, then by name. ``order`` is the fields' order in the input.

    With ``whole`` the primary field is found in inputs with more rows than the cap, too.
    """
    rows, stats = field_stats(df, ordinal, cap)
    names = [n for n in (order or []) if n in stats]
    names += [n for n in stats if n not in names]
    fields = [Field(n, stats[n][0], stats[n][1].null_count > 0, False, stats[n][1]) for n in names]
    primary = primary or (find_whole_primary(df, rows, fields, cap) if whole else find_primary(rows, fields))
    for f in fields:
        f.indexed = worth_index(f, rows)
    fields.sort(key=lambda f: (f.name != primary, f.name.lower(), f.name))
    return rows, Schema(fields, primary)


def suggest_chunk_field(schema: Schema, rows: int) -> str | None:
    """The primary field, or the complete field with the highest score."""
    if schema.primary:
        return schema.primary
    best, most = None, 0.0
    for f in schema.fields:
        if f.nullable:
            continue
        name, ratio = f.name.lower(), f.stats.cardinality / max(1, rows)
        score = 50.0 * (f.type in (NUMBER, DATE)) + (ratio * 30 if 0.1 < ratio <= 1 else 0)
        score += 20 * ("id" in name) + 15 * ("date" in name or "time" in name) + 10 * ("created" in name or "updated" in name)
        if score > most:
            best, most = f.name, score
    return best


def recommended_indexes(schema: Schema) -> list[str]:
    return schema.indexed


def spark_type(f: Field) -> T.DataType:
    return {NUMBER: T.DoubleType(), BOOLEAN: T.BooleanType()}.get(f.type, T.StringType())
