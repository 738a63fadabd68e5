"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm import topics
from corvina.llm.common import staged

OTHER = "(other)"
DIMENSIONS = ("source", "lang", "topic")
#: Up to so many cells are raked on the driver; more are raked by joins and sums of the table of cells.
DRIVER_CELLS = 200_000
SALTS = 32
#: Raking ends after so many rounds, or when no factor of a round is farther from 1 than this, on the driver and by joins alike.
ROUNDS, TOLERANCE = 200, 1e-9


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of cells of a mass so that every marginal of mass * weight meets its target shares.

    codes: for each dimension the category of each cell. Categories without mass can't be met; their share goes to the
    others in proportion.
    """
    weight, total = np.ones(len(mass)), mass.sum()
    if total <= 0:
        return weight
    wanted = []
    for at, target in zip(codes, targets):
        want = np.where(np.bincount(at, mass, len(target)) > 0, target, 0.0)
        wanted.append(want / want.sum() * total if want.sum() > 0 else None)
    for _ in range(rounds):
        off = 0.0
        for at, want in zip(codes, wanted):
            if want is None:
                continue
            have = np.bincount(at, mass * weight, len(want))
            factor = np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
            off = max(off, float(np.abs(factor[have > 0] - 1).max(initial=0.0)))
            weight *= factor[at]
        if off < tolerance:
            break
    return weight


def _on_driver(cells: pd.DataFrame, targets: dict[str, dict[str, float]], temperature: float, rounds: int, tolerance: float) -> np.ndarray:
    mass = cells["n"].to_numpy(float)
    codes, wanted = [], []
    for d in DIMENSIONS:
        at, values = pd.factorize(cells[f"c_{d}"])
        share = np.bincount(at, mass, len(values))
        want = np.array([targets[d].get(v, 0.0) for v in values]) if targets.get(d) else share**temperature * (share > 0)
        codes.append(at)
        wanted.append(want)
    return rake(mass, codes, wanted, rounds, tolerance)


def _by_joins(cells: DataFrame, targets: dict[str, dict[str, float]], temperature: float, rounds: int, tolerance: float) -> DataFrame:
    """The same for a table of cells of any size: (c_source, c_lang, c_topic, n, weight)."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("n")).first()[0] or 0)
    wanted = {}
    for d in DIMENSIONS:
        have = cells.groupBy(f"c_{d}").agg(F.sum("n").alias("n")).filter("n > 0")
        if targets.get(d):
            given = spark.createDataFrame(list(targets[d].items()), f"c_{d} string, want double")
            want = have.join(given, f"c_{d}", "left").select(f"c_{d}", F.coalesce("want", F.lit(0.0)).alias("want"))
        else:
            want = have.select(f"c_{d}", F.pow(F.col("n").cast("double"), temperature).alias("want"))
        norm = float(want.agg(F.sum("want")).first()[0] or 0)
        if norm > 0:
            wanted[d] = staged(want.withColumn("want", F.col("want") / norm * total), "wanted")
    now = cells.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        off = 0.0
        for d, want in wanted.items():
            have = now.groupBy(f"c_{d}").agg(F.sum(F.col("n") * F.col("weight")).alias("have"))
            factor = have.join(want, f"c_{d}").select(f"c_{d}", F.when(F.col("have") > 0, F.col("want") / F.col("have")).alias("f"))
            factor = staged(factor.filter("f is not null"), "factors")
            off = max(off, factor.agg(F.max(F.abs(F.col("f") - 1))).first()[0] or 0.0)
            now = now.join(factor, f"c_{d}", "left").withColumn("weight", F.col("weight") * F.coalesce("f", F.lit(1.0))).drop("f")
        now = staged(now, "raked")
        if off < tolerance:
            break
    return now


def _measured(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, carry: list[str]) -> DataFrame:
    """(id, mark, source, lang, topic, n_tokens, vector, row): the texts are read once; vector is null where the topic is given.

    mark is what a row draws by: its id, or its text's hash where it has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [t or b"" for t in x.column("text").to_pylist()]
            vectors = [None if topic_col else topics.vector(t).tobytes() for t in texts]
            columns = {
                "id": x.column("id"), "mark": x.column("mark"), "source": x.column("source"), "lang": x.column("lang"), "topic": x.column("topic"),
                "n_tokens": pa.array([len(t.split()) for t in texts], pa.int64()), "vector": pa.array(vectors, pa.binary()),
            }
            if carry:
                columns["row"] = x.column("row")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    src = df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"))).alias("mark"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        (F.col(topic_col).cast("string") if topic_col else F.lit(None).cast("string")).alias("topic"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    types = [f"id {src.schema['id'].dataType.simpleString()}", "mark long, source string, lang string, topic string, n_tokens long, vector binary"]
    if carry:
        types.append(f"row {src.schema['row'].dataType.simpleString()}")
    return src.mapInArrow(run, ", ".join(types))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: float = 0.9,
    temperature: float = 0.7,
    seed: int = 1,
    carry: list[str] | None = None,
    driver_cells: int = DRIVER_CELLS,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row for each row of df: id_col, source, lang, topic, n_tokens, weight, expected, copies;
    carry: columns of df that come along in a struct named row, which spares a join.

    topic is topic_col, or the cluster of the text that k-means over all rows gives (topics.learn). Tokens (words) are
    summed by cell of source, language and topic; the cells are raked to the target marginals. A document is expected
    keep * weight times and taken copies times: the whole part surely, the fraction by a draw that a hash of seed and id
    decides, so a rerun draws the same. So the copies meet the target marginals and have keep of all tokens; a weight over
    1 / keep gives documents that are taken more than once.
    targets: shares for any of "source", "lang", "topic"; values that it doesn't name are the one category OTHER, which it
    may name too. Marginals that aren't given are the measured shares to the power temperature, every value a category of
    its own. Up to driver_cells cells are raked on the driver and broadcast; more are raked and joined as a table, in the same rounds.

    Edge cases: a null source or language is a category of its own (of the given targets: OTHER); a null or blank text has 0
    tokens and the weight of its cell, 1 if the cell has no tokens; rows with equal ids are taken equally often if their
    cells are equal; rows with a null id draw by their text; an empty table gives no rows; columns that are not named are ignored.
    """
    targets = targets or {}
    rows = staged(_measured(df, id_col, text_col, source_col, lang_col, topic_col, carry or []), "measured")
    if topic_col is None:
        mean, centres = topics.learn(rows)

        def assign(v: pd.Series) -> pd.Series:
            m = np.frombuffer(b"".join(v), dtype=np.int8).reshape(-1, topics.WIDTH).astype(np.float64)
            return pd.Series([f"t{k:02}" for k in topics.nearest(m, mean, centres)])

        rows = rows.withColumn("topic", F.pandas_udf(assign, "string")("vector"))
    rows = rows.drop("vector")

    def category(d: str) -> Column:
        if not targets.get(d):
            return F.coalesce(F.concat(F.lit("="), d), F.lit(OTHER))
        named = [k for k in targets[d] if k != OTHER]
        return F.when(F.col(d).isin(named), F.concat(F.lit("="), d)).otherwise(OTHER)

    keys = [f"c_{d}" for d in DIMENSIONS]
    wanted = {d: {OTHER if k == OTHER else f"={k}": v for k, v in t.items()} for d, t in targets.items()}
    rows = rows.withColumns({f"c_{d}": category(d) for d in DIMENSIONS})
    if topic_col is None:  # topics are computed once
        rows = staged(rows, "topics")
    salt = F.pmod(F.xxhash64("id", "mark"), F.lit(SALTS)).cast("int")
    cells = staged(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n"), F.collect_set(salt).alias("salts")), "cells")
    few = cells.drop("salts").limit(driver_cells + 1).toPandas()
    if len(few) <= driver_cells:
        few = few.sort_values(keys, kind="stable")
        few["weight"] = _on_driver(few, wanted, temperature, rounds, tolerance)
        found = df.sparkSession.createDataFrame(few[[*keys, "weight"]].values.tolist(), ", ".join(f"{k} string" for k in keys) + ", weight double")
        out = rows.join(F.broadcast(found), keys)
    else:
        raked = _by_joins(cells.drop("salts"), wanted, temperature, rounds, tolerance).select(*keys, "weight")
        salted = cells.select(*keys, F.explode("salts").alias("salt")).join(raked, keys)
        out = rows.withColumn("salt", salt).join(salted, [*keys, "salt"])
    drawn = F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), F.col("mark"))).otherwise(F.xxhash64(F.lit(seed), F.col("id")))
    draw = F.pmod(drawn, F.lit(1 << 53)) / float(1 << 53)
    expected = F.col("weight") * F.lit(float(keep))
    return out.select(
        F.col("id").alias(id_col),
        "source",
        "lang",
        "topic",
        "n_tokens",
        "weight",
        expected.alias("expected"),
        (F.floor(expected) + (draw < expected - F.floor(expected)).cast("long")).alias("copies"),
        *(["row"] if carry else []),
    )
