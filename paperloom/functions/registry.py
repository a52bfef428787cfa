"""User functions: registry with provenance, folds, spaces, rankers, passes, detectors, model batches."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    """A function with its id, version, description, parameters, laws and spaces."""
    fid: str
    fn: Callable
    version: str = "1"
    description: str = ""
    params: tuple = ()
    laws: tuple = ()
    space_in: str = "scalar"
    space_out: str = "scalar"


class Functions:
    """Functions on columns, kept under an id and run with their provenance."""

    def __init__(self) -> None:
        self._specs: dict[str, Spec] = {}

    def add(self, spec: Spec) -> Spec:
        if spec.fid in self._specs:
            raise ValueError(f"{spec.fid} is registered already")
        self._specs[spec.fid] = spec
        return spec

    def get(self, fid: str) -> Spec:
        return self._specs[fid]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.fid, s.version, s.description, list(s.params), list(s.laws), s.space_in, s.space_out) for s in sorted(self._specs.values(), key=lambda s: s.fid)]
        return spark.createDataFrame(rows, "fid string, version string, description string, params array<string>, laws array<string>, space_in string, space_out string")

    def run(self, df: DataFrame, fid: str, *cols: str, alias: str = "value") -> DataFrame:
        """Result column plus the id and version that produced it."""
        s = self.get(fid)
        return df.select("*", s.fn(*[F.col(c) for c in cols]).alias(alias), F.lit(s.fid).alias("produced_by"), F.lit(s.version).alias("version"))


@dataclass(frozen=True)
class Fold:
    """User accumulator: identity, combine and a read-out after the fold. Works on bounded arrays and as a two-level fold."""
    zero: Column
    combine: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] | None = None
    laws: tuple = ("commutative", "associative")

    def over(self, values: Column) -> Column:
        return F.aggregate(values, self.zero, self.combine, self.finish) if self.finish else F.aggregate(values, self.zero, self.combine)

    def by(self, df: DataFrame, keys: list[str], value: Column) -> DataFrame:
        """Fold of a whole key. Every Arrow batch of a task is folded before anything is shuffled, then the results of a split's
        batches, of ``FAN_IN`` splits, and the rest: no array is longer than a batch or ``FAN_IN`` partial results, whatever a
        key holds, and only partial results travel.
        """
        d = df.select(*keys, value.alias("__v"))
        fields = [*d.schema.fields[:-1], T.StructField("__split", T.LongType()), T.StructField("__l", T.ArrayType(d.schema["__v"].dataType))]
        d = d.mapInArrow(_batches_by_key, T.StructType(fields)).select(*keys, "__split", F.aggregate("__l", self.zero, self.combine).alias("__v"))
        for split in (F.col("__split"), F.floor(F.col("__split") / FAN_IN)):
            d = d.groupBy(*keys, split.alias("__split")).agg(F.collect_list("__v").alias("__l")).select(*keys, "__split", F.aggregate("__l", self.zero, self.combine).alias("__v"))
        last = F.aggregate(F.collect_list("__v"), self.zero, self.combine)
        return d.groupBy(*keys).agg((self.finish(last) if self.finish else last).alias("value"))


FAN_IN = 4096  # partial results that one row brings together


def _batches_by_key(batches):
    """The values of each key of a batch as one list. The last column holds the values, the others are the keys; nulls are left out."""
    from pyspark import TaskContext

    split = TaskContext.get().partitionId()
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(batch.num_columns - 1)))
        *keys, values = batch.columns
        if not batch.num_rows:
            continue
        code = np.zeros(batch.num_rows, dtype=np.int64)
        for k in keys:
            coded = k.dictionary_encode()
            code = np.unique(code, return_inverse=True)[1] * (len(coded.dictionary) + 1) + pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False) + 1
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), values.take(pa.array(order)))
        head = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([*(k.take(head) for k in keys), pa.array(np.full(len(first), split), pa.int64()), lists], names=[*batch.schema.names[:-1], "__split", "__l"])


# --- spaces -------------------------------------------------------------------------------------------------------


def compare(a: Column, b: Column, descending: bool = False) -> Column:
    """Order of a space as -1, 0 or 1, null when a side is missing."""
    out = F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0)
    return -out if descending else out


def compare_product(parts: Iterable[Column]) -> Column:
    """Component-wise order of a product: null when the components disagree."""
    parts = list(parts)
    up, down = F.greatest(*parts), F.least(*parts)
    missing = sum(F.when(p.isNull(), 1).otherwise(0) for p in parts) > 0
    return F.when(missing, None).when((up == 0) & (down == 0), 0).when(down >= 0, 1).when(up <= 0, -1)


# --- rankers, passes, modules -------------------------------------------------------------------------------------


class Rankers:
    """Rankers by aspect; one that is missing or fails to plan falls back to the structural one."""

    def __init__(self, structural: Callable[[DataFrame], DataFrame]) -> None:
        self._by_aspect: dict[str, Callable[[DataFrame], DataFrame]] = {"structural": structural}

    def add(self, aspect: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self._by_aspect[aspect] = fn

    def rank(self, units: DataFrame, aspect: str) -> DataFrame:
        fn = self._by_aspect.get(aspect)
        if fn is not None and aspect != "structural":
            try:
                out = fn(units)
                out.schema  # noqa: B018 - planning errors show here
                return out.withColumn("aspect", F.lit(aspect))
            except AnalysisException as e:  # what does not plan; faults of the function itself are not hidden
                logging.getLogger(__name__).warning("ranker %s does not plan, the structural one takes its place: %s", aspect, e)
        return self._by_aspect["structural"](units).withColumn("aspect", F.lit("structural"))


@dataclass
class Pass:
    name: str
    fn: Callable[[DataFrame], DataFrame]
    needs: tuple = field(default=())


def order_passes(passes: list[Pass]) -> list[Pass]:
    """Passes ordered by their requirements, the given order kept where it is free."""
    done, out, rest = set(), [], list(passes)
    while rest:
        ready = next((p for p in rest if all(n in done or n not in {q.name for q in passes} for n in p.needs)), None)
        if ready is None:
            raise ValueError("the requirements of the passes form a cycle")
        rest.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def run_passes(df: DataFrame, passes: list[Pass], only: set | None = None, skip: set | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Chain of ``transform`` steps. A pass that fails to plan is skipped with everything that needs it."""
    status, bad = [], set()
    for p in order_passes(passes):
        if (only and p.name not in only) or (skip and p.name in skip):
            status.append((p.name, "skipped"))
            continue
        if any(n in bad for n in p.needs):
            bad.add(p.name)
            status.append((p.name, "blocked"))
            continue
        try:
            nxt = df.transform(p.fn)
            nxt.schema  # noqa: B018
            df = nxt
            status.append((p.name, "ok"))
        except Exception as e:
            bad.add(p.name)
            status.append((p.name, f"failed: {type(e).__name__}"))
    return df, status


def modules(spec: str, known: dict[str, Callable[..., DataFrame]]) -> list[Pass]:
    """Operators listed in JSON as ``[{"order": 1, "name": "...", "params": {...}}]``, in their order; unknown names fail."""
    out = []
    for row in sorted(json.loads(spec), key=lambda r: r.get("order", 0)):
        fn, params = known[row["name"]], row.get("params", {})
        out.append(Pass(row["name"], lambda df, fn=fn, params=params: fn(df, **params)))
    return out


# --- detectors and models -----------------------------------------------------------------------------------------


class Detectors:
    """Detector per object kind and input format; a format without one gives no rows."""

    def __init__(self) -> None:
        self._by: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}

    def add(self, kind: str, fmt: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self._by[(kind, fmt)] = fn

    def detect(self, docs: DataFrame, kind: str) -> DataFrame:
        """``docs`` carry a ``format`` column; every detector sees the rows of its format."""
        out = None
        for (k, fmt), fn in sorted(self._by.items()):
            if k == kind:
                d = fn(docs.where(F.col("format") == fmt)).withColumn("format", F.lit(fmt)).withColumn("kind", F.lit(kind))
                out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        if out is None:
            raise KeyError(f"no detector for {kind}")
        return out


def annotate(sentences: DataFrame, key: list[str], text: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]] | None], rows: int = 256) -> DataFrame:
    """Token annotations by a model that each worker loads once; without a model there are no rows.

    The model gets at most ``rows`` sentences of a batch at once, so a worker holds the tokens of those.
    """
    fields = [sentences.schema[k] for k in key]
    schema = T.StructType([*fields, T.StructField("token_no", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("tag", T.StringType())])

    def run(batches):
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf) if model is not None else 0, rows):
                part, out = pdf.iloc[at:at + rows], []
                for head, toks in zip(part[key].itertuples(index=False, name=None), model(part[text].tolist())):
                    out += [(*head, i, tok, tag) for i, (tok, tag) in enumerate(toks)]
                yield pd.DataFrame(out, columns=[f.name for f in schema])

    return sentences.select(*key, text).mapInPandas(run, schema)


def map_texts(df: DataFrame, text: str, fn: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """Text replaced by a caller's function over lists of texts; the old text stays as ``<text>_source``. Row order inside
    a batch is kept."""
    schema = T.StructType([*df.schema.fields, T.StructField(f"{text}_source", T.StringType())])

    def run(batches):
        for pdf in batches:
            src = pdf[text].tolist()
            done: list[str] = []
            for i in range(0, len(src), batch):
                done += fn(src[i:i + batch])
            pdf = pdf.copy()
            pdf[f"{text}_source"] = src
            pdf[text] = done
            yield pdf

    return df.mapInPandas(run, schema)


def run_tasks(tasks: DataFrame, key: str, prompt: str, fn: Callable[[list[str]], list[str]], batch: int = 20) -> DataFrame:
    """Answers of a caller's function per task id. Equal prompts are asked once; join the result to the tasks by id."""
    asked = tasks.select(F.col(prompt).alias("text")).distinct()
    answers = map_texts(asked, "text", fn, batch).select(F.col("text_source").alias(prompt), F.col("text").alias("answer"))
    return tasks.select(key, prompt).join(answers, prompt).select(key, "answer")
