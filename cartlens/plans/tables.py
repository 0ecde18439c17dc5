"""Result tables in a commit log, hash-bucketed by key: changes are written as deltas and merged on read.

A table is a list of segments, each the owner of some buckets, and a list of deltas. A delta holds the keys that a
change touched and their new rows; both lie in the buckets of their keys. A reader takes untouched buckets as they are,
and in the others replaces the rows of touched keys by those of the last delta that touched them. So a change
writes what it changes, not the table; after some deltas the touched buckets alone are written anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.plans.commits import CommitLog, Conflict, State

BUCKETS = 64
# A table is compacted once it has more deltas, a sum table once a level has more segments.
MOST_DELTAS = 8
_BUCKET, _SEQ, _LAST = "_bucket", "_seq", "_last"


def _same(columns: list[str], left: str, right: str):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


class LoggedTable:
    """One table of a commit log, read as of the current entry or as of a given state."""

    def __init__(self, log: CommitLog, name: str, state: State | None = None):
        self.log, self.name, self.spark = log, name, log.spark
        self._pinned = state

    # --- reading

    def entry(self) -> dict | None:
        return (self._pinned or self.log.current()).tables.get(self.name)

    def exists(self) -> bool:
        return self.entry() is not None

    def generation(self) -> int:
        """Number of the commit that last replaced the table as a whole."""
        return self._found()["since"]

    def _found(self) -> dict:
        entry = self.entry()
        if entry is None:
            raise FileNotFoundError(f"no committed table {self.name} below {self.log.folder}")
        return entry

    def read(self) -> DataFrame:
        return self._merged(self._found())

    def _schema(self, entry: dict) -> T.StructType:
        return T.StructType.fromJson(entry["schema"])

    def _parquet(self, entry: dict, part: dict, columns: list[str] | None = None) -> DataFrame:
        fields = [f for f in self._schema(entry).fields if columns is None or f.name in columns]
        bucketed = entry["keys"] and part.get("buckets") is not None
        if not bucketed:
            return self.spark.read.schema(T.StructType(fields)).parquet(part["path"])
        schema = T.StructType([*fields, T.StructField(_BUCKET, T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(f"{part['path']}{'/keys' if columns else '/rows' if 'seq' in part else ''}")
        return found.where(F.col(_BUCKET).isin(part["buckets"]))

    def _merged(self, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets: partitions of other buckets are not read."""
        names = [f.name for f in self._schema(entry).fields]
        keys, empty = entry["keys"], self.spark.createDataFrame([], self._schema(entry))
        if not keys:
            return self._union([self._parquet(entry, s) for s in entry["segments"]], empty)
        own = (lambda df: df if buckets is None else df.where(F.col(_BUCKET).isin(sorted(buckets))))
        base = [own(self._parquet(entry, s)) for s in entry["segments"] if s["buckets"]]
        deltas = [d for d in entry["deltas"] if d["buckets"]]
        if not deltas:
            return self._union([b.select(names) for b in base], empty)
        touched = sorted({b for d in deltas for b in d["buckets"]})
        last = reduce(
            DataFrame.unionAll,
            [own(self._parquet(entry, d, keys)).select(*keys, F.lit(d["seq"]).alias(_LAST)) for d in deltas],
        ).groupBy(*keys).agg(F.max(_LAST).alias(_LAST))
        clean = [b.where(~F.col(_BUCKET).isin(touched)).select(names) for b in base]
        dirty = [b.where(F.col(_BUCKET).isin(touched)).select(names) for b in base]
        kept = [d.alias("a").join(last.alias("b"), _same(keys, "a", "b"), "left_anti") for d in dirty]
        fresh = reduce(
            DataFrame.unionAll, [own(self._parquet(entry, d)).select(*names, F.lit(d["seq"]).alias(_SEQ)) for d in deltas]
        )
        newest = _same(keys, "a", "b") & (F.col(f"a.{_SEQ}") == F.col(f"b.{_LAST}"))
        fresh = fresh.alias("a").join(last.alias("b"), newest, "left_semi").select(names)
        return self._union([*clean, *kept, fresh], empty)

    @staticmethod
    def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionAll, parts) if parts else empty

    # --- writing

    def staged(self, df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> dict:
        """Write a whole new content; the entry that will name it, still without a commit number."""
        path = self.log.fresh_path(self.name)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        if keys:
            _write_bucketed(df, keys, buckets, path)
        else:
            df.write.parquet(path)
        segment = {"path": path, "buckets": list(range(buckets)) if keys else None, "level": 0}
        return {
            "schema": schema.jsonValue(), "keys": keys or [], "n_buckets": buckets, "since": None,
            "segments": [segment], "deltas": [],
        }

    def refresh(self, df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
        """Replace the whole content, also by an empty table; keys stay what they were unless given."""
        before = self.entry()
        if keys is None and before is not None:
            keys, buckets = before["keys"], before["n_buckets"]
        entry = self.staged(df, keys, buckets)
        self.log.commit(lambda state: state.changed({self.name: entry | {"since": state.number + 1}}))
        return self.read()

    def append(self, df: DataFrame, streams: dict | None = None) -> None:
        """Add rows to a table without keys, which this makes where it is missing."""
        path = self.log.fresh_path(self.name)
        df.write.parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]).jsonValue()
        segment = {"path": path, "buckets": None, "level": 0}

        def change(state: State) -> State | None:
            if streams and all(state.streams.get(k, -1) >= v for k, v in streams.items()):
                return None  # a replay: what it adds is there already
            entry = state.tables.get(self.name) or {
                "schema": schema, "keys": [], "n_buckets": 0, "since": state.number + 1, "segments": [], "deltas": [],
            }
            if entry["keys"]:
                raise ValueError(f"{self.name} has keys; rows are added by upsert")
            return state.changed({self.name: entry | {"segments": [*entry["segments"], segment]}}, streams=streams)

        self.log.commit(change)

    def upsert(self, new: DataFrame, touched: DataFrame, generation: int | None = None) -> None:
        """Replace all rows of the touched keys by ``new``, whose keys must be among them.

        A touched key without new rows loses its rows. With ``generation`` the change holds only for that content:
        if the table has been replaced since, ``Conflict`` is raised. Two changes of one key both stand
        in the log; the later entry counts.
        """
        entry = self._found()
        keys, number = entry["keys"], entry["n_buckets"]
        path = self.log.fresh_path(self.name)
        _write_bucketed(touched.select(*keys).distinct(), keys, number, f"{path}/keys")
        _write_bucketed(new.select([f.name for f in self._schema(entry).fields]), keys, number, f"{path}/rows")
        delta = {"path": path, "buckets": sorted(self._buckets_in(f"{path}/keys"))}

        def change(state: State) -> State:
            now = state.tables.get(self.name)
            if now is None or now["keys"] != keys or now["n_buckets"] != number:
                raise Conflict(f"{self.name} has other keys now")
            if generation is not None and now["since"] != generation:
                raise Conflict(f"{self.name} was replaced by commit {now['since']}")
            deltas = [*now["deltas"], delta | {"seq": state.number + 1}]
            return state.changed({self.name: now | {"deltas": deltas}})

        after = self.log.commit(change)
        if len(after.tables[self.name]["deltas"]) > MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Write the touched buckets anew, without their deltas; other buckets stay where they are.

        Deltas that arrive meanwhile stay deltas of the new segment. Where the table was replaced or
        compacted meanwhile, nothing is left to do.
        """
        entry = self._found()
        touched = {b for d in entry["deltas"] for b in d["buckets"]}
        if not touched:
            return
        path = self.log.fresh_path(self.name)
        _write_bucketed(self._merged(entry, touched), entry["keys"], entry["n_buckets"], path)

        def change(state: State) -> State | None:
            now = state.tables.get(self.name)
            done = len(entry["deltas"])
            if now is None or now["segments"] != entry["segments"] or now["deltas"][:done] != entry["deltas"]:
                return None
            left = [s | {"buckets": [b for b in s["buckets"] if b not in touched]} for s in now["segments"]]
            segments = [s for s in left if s["buckets"]] + [{"path": path, "buckets": sorted(touched), "level": 0}]
            return state.changed({self.name: now | {"segments": segments, "deltas": now["deltas"][done:]}})

        self.log.commit(change)

    def merge_segments(self, combine: Callable[[DataFrame], DataFrame], most: int = MOST_DELTAS) -> None:
        """Put more than ``most`` segments of one level together as one of the next, their rows through ``combine``.

        A row is written anew once per level, so the work for a batch follows its size, not the table's.
        """
        while True:
            entry = self._found()
            levels: dict[int, list] = {}
            for segment in entry["segments"]:
                levels.setdefault(segment["level"], []).append(segment)
            full = next((n for n in sorted(levels) if len(levels[n]) > most), None)
            if full is None:
                return
            group = levels[full]
            path = self.log.fresh_path(self.name)
            combine(self._union([self._parquet(entry, s) for s in group], None)).write.parquet(path)

            def change(state: State) -> State | None:
                now = state.tables[self.name]
                if any(s not in now["segments"] for s in group):
                    return None
                rest = [s for s in now["segments"] if s not in group]
                return state.changed({
                    self.name: now | {"segments": [*rest, {"path": path, "buckets": None, "level": full + 1}]}
                })

            self.log.commit(change)

    def _buckets_in(self, path: str) -> list[int]:
        """Buckets with files below a written folder."""
        hadoop, files = self.log.files()
        found = files.globStatus(hadoop(f"{path}/{_BUCKET}=*")) or []
        return [int(s.getPath().getName().removeprefix(f"{_BUCKET}=")) for s in found]


def _write_bucketed(df: DataFrame, keys: list[str], buckets: int, path: str) -> None:
    """One folder per bucket of the first key; the hint lets adaptive execution split a bucket with many rows."""
    bucket = F.pmod(F.xxhash64(F.col(keys[0])), F.lit(buckets)).cast("int")
    dealt = df.withColumn(_BUCKET, bucket).hint("rebalance", _BUCKET)
    dealt.write.partitionBy(_BUCKET).parquet(path)


class Run:
    """Tables and models of one run, seen by nobody until they are committed together."""

    def __init__(self, log: CommitLog):
        self.log = log
        self.tables: dict[str, dict] = {}
        self.models: dict[str, str] = {}

    def replace(self, name: str, df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
        """Write a table's new content; returns it as written."""
        self.tables[name] = LoggedTable(self.log, name).staged(df, keys, buckets)
        return LoggedTable(self.log, name, State(tables=self.tables)).read()

    def save_model(self, name: str, model) -> None:
        path = self.log.fresh_path(f"model-{name}")
        model.write().save(path)
        self.models[name] = path

    def commit(self) -> State:
        """All tables and models of the run at once; those of an earlier run go with it."""
        return self.log.commit(
            lambda state: state.changed(
                {n: e | {"since": state.number + 1} for n, e in self.tables.items()}, self.models
            )
        )
