"""Detection over an event stream: Spark's keyed state, one detector per rule and part of its keys.

Events fan out as in batch. Keys are dealt into parts by a hash, since each call for a state costs
milliseconds, whatever it holds. The state of a rule and part is, for each of its keys, the rows of the
open window, the end of the last match, and the alert that later matches may still join, as totals and
first values. Timers of event time settle it: a match is told once the watermark has passed its end, an
alert once no later match can join it. So state does not grow with the stream or with an alert, a batch
costs what it brings and what is open, and each result is written once. Matches come from the kernels of
the batch detectors, for all keys of a part at once.

Results equal batch results as long as no row is later than `lateness`; later rows are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence as Seq
from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberwatch.functions import times
from emberwatch.operators import geo as G
from emberwatch.operators import kernels as K
from emberwatch.packaging import ship
from emberwatch.plans import detect as D
from emberwatch.plans.rules import Burst, Rule, Sequence, Travel

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Event columns that evidence and alerts keep.
EVIDENCE = {"source": "string", "raw": "string", "src_ip": "string", "port": "int", "user": "string", "host": "string", "path": "string"}
_PLACE = {"city": "string", "cc": "string", "lat": "double", "lon": "double"}
_INPUT = {
    "entity_key": "string", "t": "bigint", "tie": "bigint", "mask": "bigint", "amount": "string", "counted": "string", "entity": "string",
    **EVIDENCE, **_PLACE,
}
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_ROWS = pa.schema([(n, _ARROW[k]) for n, k in _INPUT.items()])
_SPAN = {"alert_t": "bigint", "s_t": "bigint", "s_tie": "bigint", "e_t": "bigint", "e_tie": "bigint"}
_OUTPUT = {
    "kind": "string", "rule_id": "string", "entity_key": "string", **_SPAN, "t": "bigint", "tie": "bigint",
    **EVIDENCE, "body": "string",
}


#: Parts that the keys of a rule are dealt into, for good. Each is one state.
PARTS = 512
#: Rows of a piece of a state.
_CHUNK = 10_000


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {k}" for n, k in columns.items())


@dataclass(frozen=True)
class _Keyed:
    """What the state of a rule needs to know about it."""

    window: int
    kind: str
    need: int = 0
    distinct: bool = False
    steps: tuple[int, ...] = ()
    min_km: float = 0.0
    min_kmh: float = 0.0

    @staticmethod
    def of(rule: Rule) -> _Keyed:
        d, w = rule.detect, D.window_micros(rule)
        if isinstance(d, Burst):
            return _Keyed(w, "burst", need=d.count, distinct=d.distinct is not None)
        if isinstance(d, Sequence):
            return _Keyed(w, "sequence", steps=tuple(s.count for s in d.steps))
        return _Keyed(w, "travel", min_km=d.min_km, min_kmh=d.min_kmh)


def _first(values: list, value, most: int | None = None) -> None:
    """Add a value that is not there yet, up to a number of them."""
    if value not in (None, "") and value not in values and (most is None or len(values) < most):
        values.append(value)


class _Alert:
    """The alert that matches of a rule and key fold into, as bounded totals (a JSON object)."""

    def __init__(self, body: dict) -> None:
        self.body = body

    @staticmethod
    def begin(t: int, entity: str) -> _Alert:
        lists = {name: [] for name in (*D.LISTED, "sources")}
        return _Alert(
            {"alert_t": t, "entity": json.loads(entity), "n_matches": 0, "n": 0, "first_t": t, "last_t": t,
             "last_user": None, "last_host": None, **lists, "last": {}, "pair": None, "edge": [t, []]}
        )

    def joins(self, first_t: int, window: int) -> bool:
        return first_t - self.body["last_t"] <= window

    def add(self, rows: list[dict], last: dict, pair: dict | None, shares: bool) -> list[dict]:
        """Fold a match in; its rows without those that an earlier match of the alert has."""
        b = self.body
        # an earlier match can share rows of the time at which it ended only
        edge_t, edge = b["edge"]
        kept = [r for r in rows if not (shares and r["t"] == edge_t and r["raw"] in edge)]
        b["n_matches"] += 1
        b["last"], b["pair"] = last, pair
        for r in kept:
            b["n"] += 1
            b["last_user"] = r["user"] or b["last_user"]
            b["last_host"] = r["host"] or b["last_host"]
            for name, (column, most) in D.LISTED.items():
                _first(b[name], r[column], most)
            _first(b["sources"], r["source"])
        end = max(r["t"] for r in rows)
        if end > b["last_t"] or b["n_matches"] == 1:
            b["edge"] = [end, []]
        b["last_t"] = max(b["last_t"], end)
        if shares:
            b["edge"][1] += [r["raw"] for r in rows if r["t"] == b["last_t"] and r["raw"] not in b["edge"][1]]
        return kept


class KeyedDetector(StatefulProcessor):
    """Finds and folds the matches of one rule and part of its keys.

    What is kept of a key besides its rows: `after` (the last match's end), `alert`, `before`.
    """

    def __init__(self, rules: dict[str, _Keyed]) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "chunk binary")
        self.memory = handle.getValueState("memory", "body string")
        self.timer = handle.getValueState("timer", "at bigint")

    def close(self) -> None:
        pass

    # --- state ---

    def _load(self) -> dict[str, dict]:
        return json.loads(self.memory.get()[0]) if self.memory.exists() else {}

    @staticmethod
    def _of(memory: dict[str, dict], name: str) -> dict:
        return memory.setdefault(name, {"after": [K.LOWEST, K.LOWEST], "alert": None, "before": None})

    def _table(self) -> pa.Table:
        chunks = [pa.ipc.read_record_batch(pa.py_buffer(bytes(c[0])), _ROWS) for c in self.rows.get()]
        order = [(c, "ascending") for c in ("entity_key", "t", "tie", "mask")]
        return pa.Table.from_batches(chunks, _ROWS).sort_by(order).combine_chunks()

    def _keep(self, rows: pa.Table) -> None:
        if len(rows):
            chunks = rows.combine_chunks().to_batches(_CHUNK)
            self.rows.put([(c.serialize().to_pybytes(),) for c in chunks])
        else:
            self.rows.clear()

    def _set_timer(self, was: int | None, at: int | None, now: int) -> None:
        """One timer, in milliseconds of event time, for `at` microseconds."""
        wanted = None if at is None else -(-at // 1000)
        if wanted == was:
            return
        if was is not None and was > now:
            self.handle.deleteTimer(was)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    # --- Spark's calls ---

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rule, earliest = self.rules[key[0]], None
        for part in rows:
            chunk = pa.RecordBatch.from_pandas(part[list(_INPUT)], _ROWS, preserve_index=False)
            self.rows.appendValue((chunk.serialize().to_pybytes(),))
            least = int(part["t"].min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            due = earliest if rule.kind == "travel" else earliest + rule.window
            was = self.timer.get()[0] if self.timer.exists() else None
            if was is None or -(-due // 1000) < was:
                self._set_timer(was, due, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        now, rule, memory = now_ms * 1000, self.rules[key[0]], self._load()
        table = self._table() if self.rows.exists() else _ROWS.empty_table()
        out: list[dict] = []
        find = self._pairs if rule.kind == "travel" else self._spans
        kept = find(key[0], rule, memory, table, now, out)
        self._keep(kept)
        due = []
        if len(kept):
            first = int(K.column(kept, "t").min())
            due.append(first if rule.kind == "travel" else first + rule.window)
        waiting = set(kept.column("entity_key").unique().to_pylist())
        for name, own in list(memory.items()):
            if own["alert"] and now >= own["alert"]["last_t"] + 2 * rule.window:
                out.append(self._told("alert", key[0], name, own["alert"]))
                own["alert"] = None
            if own["alert"]:
                due.append(own["alert"]["last_t"] + 2 * rule.window)
            elif own["before"]:
                due.append(own["before"]["t"] + rule.window)
            elif name not in waiting:
                del memory[name]
        # the timer has just fired
        self._set_timer(None, min(due, default=None), now_ms)
        if not due:
            self.timer.clear()
        if memory:
            self.memory.update((json.dumps(memory),))
        else:
            self.memory.clear()
        if out:
            kinds = {"bigint": "Int64", "int": "Int32", "string": object}
            columns = {n: pd.Series([r.get(n) for r in out], dtype=kinds[k]) for n, k in _OUTPUT.items()}
            frame = pd.DataFrame(columns)
            yield frame

    # --- matches ---

    def _spans(self, rule_id: str, rule: _Keyed, memory: dict[str, dict], table: pa.Table, now: int, out: list[dict]) -> pa.Table:
        """Tell bursts and sequences that end by now; the rows that can still begin or continue one."""
        n = len(table)
        if not n:
            return table
        constant = {"rule_id": rule_id, "w": rule.window, "need": rule.need, "counts_values": rule.distinct}
        given = table.drop_columns(["amount"])
        for name, value in constant.items():
            given = given.append_column(name, pa.array([value] * n))
        given = given.append_column("amount", self._amounts(table))
        found = K.bursts(given) if rule.kind == "burst" else K.sequences({rule_id: list(rule.steps)})(given)
        begins = K.group_starts(table, ["entity_key"])
        of, names = np.cumsum(begins) - 1, table.column("entity_key").filter(pa.array(begins)).to_pylist()

        def later(t: np.ndarray, tie: np.ndarray, row: np.ndarray | slice) -> np.ndarray:
            """Whether positions are after the last match of their rows' key."""
            none = {"after": [K.LOWEST, K.LOWEST]}
            after = np.array([memory.get(x, none)["after"] for x in names], dtype=np.int64)[of[row]]
            return (t > after[:, 0]) | ((t == after[:, 0]) & (tie > after[:, 1]))

        kept = np.flatnonzero(later(*found.start, found.rows))
        path = kept[K.chain(found.among(kept))]
        path = path[found.end[0][path] <= now]
        which, row = found.inside(path)
        held = table.take(pa.array(row)).to_pylist()
        edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            c = which[a]
            span = [int(x[c]) for x in (*found.start, *found.end)]
            own = self._of(memory, held[a]["entity_key"])
            self._fold(rule_id, rule, own, held[a:b], span, None, out)
            own["after"] = span[2:]
        t, tie = K.column(table, "t"), K.column(table, "tie")
        return table.filter(pa.array((t > now - rule.window) & later(t, tie, slice(None))))

    @staticmethod
    def _amounts(table: pa.Table) -> pa.Array:
        texts = table.column("amount").to_pylist()
        if any("." in x for x in texts):
            return pa.array([Decimal(x) for x in texts], pa.decimal128(38, 6))
        return pa.array([int(x) for x in texts], pa.int64())

    def _pairs(self, rule_id: str, rule: _Keyed, memory: dict[str, dict], table: pa.Table, now: int, out: list[dict]) -> pa.Table:
        """Tell pairs of neighbouring rows by now that no traveller can make; the later rows."""
        known = K.column(table, "t") <= now if len(table) else np.zeros(0, dtype=bool)
        for row in table.filter(pa.array(known)).to_pylist():
            own = self._of(memory, row["entity_key"])
            before, own["before"] = own["before"], row
            pair = _journey(before, row, rule) if before else None
            if pair:
                span = [before["t"], before["tie"], row["t"], row["tie"]]
                self._fold(rule_id, rule, own, [before, row], span, pair, out)
        for own in memory.values():
            if own["before"] and own["before"]["t"] <= now - rule.window:
                own["before"] = None
        return table.filter(pa.array(~known))

    def _fold(self, rule_id: str, rule: _Keyed, own: dict, rows: list[dict], span: list[int], pair: dict | None, out: list[dict]) -> None:
        alert = _Alert(own["alert"]) if own["alert"] else None
        name, first_t = rows[0]["entity_key"], min(r["t"] for r in rows)
        if alert is None or not alert.joins(first_t, rule.window):
            if alert:
                out.append(self._told("alert", rule_id, name, alert.body))
            alert = _Alert.begin(first_t, rows[0]["entity"])
        last = {
            "distinct_values": len({r["counted"] for r in rows} - {None}),
            "total": str(sum(Decimal(r["amount"]) for r in rows)),
            "hits_from_last": [sum(r["mask"] >> back & 1 for r in rows) for back in range(max(1, len(rule.steps)))],
        }
        kept = alert.add(rows, last, pair, shares=rule.kind != "burst")
        own["alert"] = alert.body
        spans = dict(zip(_SPAN, [alert.body["alert_t"], *span], strict=True))
        for r in kept:
            out.append({"kind": "evidence", "rule_id": rule_id, "entity_key": name, **spans, **{c: r[c] for c in ("t", "tie", *EVIDENCE)}})
        out.append(self._told("open", rule_id, name, alert.body))

    @staticmethod
    def _told(kind: str, rule_id: str, name: str, body: dict) -> dict:
        shown = {k: v for k, v in body.items() if k != "edge"}
        return {"kind": kind, "rule_id": rule_id, "entity_key": name, "alert_t": body["alert_t"], "body": json.dumps(shown)}


def _journey(a: dict, b: dict, rule: _Keyed) -> dict | None:
    """The way between two rows, if it is too far for the time."""
    gap = b["t"] - a["t"]
    if a["src_ip"] == b["src_ip"] or not 0 < gap <= rule.window or a["lat"] is None or b["lat"] is None:
        return None
    lat1, lon1, lat2, lon2 = np.radians([a["lat"], a["lon"], b["lat"], b["lon"]])
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.sin((lon2 - lon1) / 2) ** 2 * np.cos(lat1) * np.cos(lat2)
    km = float(2 * G.net.EARTH_RADIUS_KM * np.arcsin(min(1.0, np.sqrt(h))))
    kmh = km / (gap / 3_600_000_000)
    if km < rule.min_km or kmh < rule.min_kmh:
        return None
    place = {f"{side}_{c}": r[c] for side, r in (("from", a), ("to", b)) for c in ("city", "cc")}
    return {"from_ip": a["src_ip"], "to_ip": b["src_ip"], **place, "km": km, "kmh": kmh, "gap": gap}


class StreamDetector:
    """Finds matches of rules in a stream of events and folds them into alerts.

    `folder` is shared storage for the results. `lateness` is how far behind the newest event a row
    may arrive; it also delays results: a match is told once its window and the lateness have
    passed. Events need a `ts` TIMESTAMP and `tie` or `line_no`, as in batch; `amounts` is the type
    of the fields that bursts total.
    """

    def __init__(
        self,
        rules: Seq[Rule],
        folder: str,
        lateness: timedelta,
        geo: DataFrame | None = None,
        amounts: str = "bigint",
    ):
        self.rules = [r for r in rules if r.enabled]
        self.folder = folder.rstrip("/")
        self.lateness = times.span_micros(lateness)
        self.geo = geo
        self._amount = amounts

    def hits(self, events: DataFrame) -> DataFrame:
        """The stream's events, fanned out, with what the state keeps of each."""
        names = events.columns
        if D.amount_type(self.rules, events.schema) != self._amount:
            raise ValueError(f"amounts are not of type {self._amount}")
        hits = D.fan_out(events.withWatermark("ts", f"{self.lateness} microseconds"), self.rules)
        if any(isinstance(r.detect, Travel) for r in self.rules):
            place = G.shipped_geo(events.sparkSession) if self.geo is None else self.geo
            hits = G.with_place(hits, place, "src_ip", "_at_")
            place_columns = {c: F.col(f"_at_{c}") for c in _PLACE}
        else:
            place_columns = {c: F.lit(None) for c in _PLACE}
        own = {c: F.col(c) if c in names else F.lit(None) for c in EVIDENCE}
        columns = {**{c: F.col(c) for c in ("entity_key", "t", "tie", "mask", "amount", "counted")}, "entity": F.to_json("entity"), **own, **place_columns}
        part = F.pmod(F.xxhash64("entity_key"), F.lit(PARTS)).alias("part")
        return hits.select(
            "ts", "rule_id", part, *(columns[c].cast(kind).alias(c) for c, kind in _INPUT.items())
        )

    def found(self, events: DataFrame) -> DataFrame:
        """The stream of evidence rows, open alerts whenever they change, and settled alerts."""
        ship(events.sparkSession)
        keyed = KeyedDetector({r.id: _Keyed.of(r) for r in self.rules})
        return self.hits(events).groupBy("rule_id", "part").transformWithStateInPandas(
            keyed, _ddl(_OUTPUT), "Append", "EventTime"
        )

    def start(
        self, events: DataFrame, checkpoint: str, partitions: int | None = None, **trigger
    ) -> StreamingQuery:
        """Write what is found to `folder`, exactly once. The state has `partitions` parts, for good: by default
        spark.sql.shuffle.partitions."""
        spark = events.sparkSession
        wanted = {_STORE: _ROCKS}  # timers and list state need it
        if partitions:
            wanted["spark.sql.shuffle.partitions"] = str(partitions)
        before = {k: spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)  # read when the query starts
        try:
            writer = (
                self.found(events).writeStream.format("parquet").partitionBy("kind")
                .option("path", self.folder).option("checkpointLocation", checkpoint)
            )
            return (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def _read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.schema(_ddl(_OUTPUT)).parquet(self.folder).where(F.col("kind") == kind).drop("kind")

    def evidence(self, spark: SparkSession) -> DataFrame:
        """Evidence told so far, with its alert's id."""
        rows = self._read(spark, "evidence").drop("body")
        return rows.withColumn("alert_id", D.alert_id(F.col("rule_id"), F.col("entity_key"), F.col("alert_t")))

    def alerts(self, spark: SparkSession, settled: bool = True) -> DataFrame:
        """Settled alerts; or else all alerts as they are now, whose ids stay the same while they grow."""
        if settled:
            return self._described(self._read(spark, "alert"))
        body = F.from_json("body", "n_matches bigint").getField("n_matches")
        rows = self._read(spark, "open").withColumn("n_matches", body)
        newest = rows.groupBy(*D.ALERT).agg(F.max_by("body", "n_matches").alias("body"))
        return self._described(newest)

    def _described(self, told: DataFrame) -> DataFrame:
        pair = "pair struct<from_ip:string, to_ip:string, from_city:string, from_cc:string, to_city:string, to_cc:string, km:double, kmh:double, gap:bigint>"
        schema = (
            "entity map<string,string>, n_matches bigint, n bigint, first_t bigint, last_t bigint, last_user string, "
            "last_host string, users array<string>, ports array<string>, paths array<string>, sources array<string>, "
            f"last struct<distinct_values:bigint, total:string, hits_from_last:array<bigint>>, {pair}"
        )
        rolled = told.select(*D.ALERT, F.from_json("body", schema).alias("b")).select(*D.ALERT, "b.*")
        rolled = rolled.withColumns(
            {
                **{name: F.array_join(name, ", ") for name in D.LISTED},
                "last": F.col("last").withField("total", F.col("last.total").cast(self._amount)),
                "last_user": F.coalesce("last_user", F.lit("an unknown account")),
                "last_host": F.coalesce("last_host", F.lit("an unknown host")),
            }
        )
        return D.described(rolled, self.rules, any(isinstance(r.detect, Travel) for r in self.rules))
