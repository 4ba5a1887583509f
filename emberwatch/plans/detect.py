"""The detection plan: events and rules to matches, evidence and alerts.

All armed rules share one scan of the events: each event fans out to the rules it can matter
to, and these hits are staged. Detectors read their narrow columns of the hits and label the
places inside a match; the labels pick the evidence out of the hits, with all its columns;
matches that touch fold into alerts.

Evidence is a table of its own (one row per event and match), never an array inside an
alert, so a match of any size stays spread over the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import schema
from emberwatch.functions import net, times
from emberwatch.functions import text as X
from emberwatch.operators import blocks, burst, correlate, geo as G, membership, sequence, travel
from emberwatch.operators.staging import staged, staged_bytes
from emberwatch.plans.rules import Burst, Rule, Sequence, Travel

KEY = ["rule_id", "entity_key"]
MATCH = [*KEY, "s_t", "s_tie"]
ALERT = [*KEY, "alert_t"]
#: Above so many bytes of labels, hits are thinned out by a bitmap before they are joined.
MANY_BYTES = 8 << 20


def window_micros(rule: Rule) -> int:
    return times.span_micros(rule.detect.within)


def per_rule(values: dict[str, object], data_type: str) -> Column:
    """A rule's constant, by rule_id."""
    out = F.lit(None).cast(data_type)
    for rule_id, value in values.items():
        out = F.when(F.col("rule_id") == rule_id, F.lit(value).cast(data_type)).otherwise(out)
    return out


def amount_type(rules: Seq[Rule], event_schema: T.StructType) -> str:
    fields = {r.detect.total for r in rules if isinstance(r.detect, Burst) and r.detect.total}
    whole = all(
        isinstance(event_schema[f].dataType, T.IntegralType)
        for f in fields
        if f in event_schema.names
    )
    return "bigint" if whole else "decimal(38,6)"


def fan_out(events: DataFrame, rules: Seq[Rule]) -> DataFrame:
    """One row per event and rule that the event can matter to.

    Adds rule_id, entity_key, entity, t, tie, amount, counted and mask to the event.
    Events without a part of the rule's key are dropped. `tie`, or line_no and feed_order (0
    if there is none), order events of equal time; without either there is no right order.
    """
    s = events.schema
    if not {"tie", "line_no"} & set(s.names):
        raise ValueError("events need a `tie` or `line_no` column, which orders those of equal time")
    amount = amount_type(rules, s)

    def column(name: str) -> Column:
        return F.col(name) if name in s.names else F.lit(None)

    found = []
    for rule in rules:
        d = rule.detect
        parts = [column(f).cast("string") for f in d.group_by]
        keyed = F.lit(True)
        for part in parts:
            keyed = keyed & F.coalesce(part != "", F.lit(False))
        mask = F.lit(1).cast("bigint")
        if isinstance(d, Sequence):
            mask = F.lit(0).cast("bigint")
            matched = F.lit(False)
            for k, step in enumerate(d.steps):
                on = step.where.bind(s)
                bit = 1 << (len(d.steps) - 1 - k)
                mask = mask + F.when(on, F.lit(bit)).otherwise(F.lit(0)).cast("bigint")
                matched = matched | on
        else:
            matched = d.where.bind(s)
        if isinstance(d, Travel):
            address = column("src_ip").cast("string")
            matched = matched & F.coalesce(address != "", F.lit(False)) & ~net.is_private(address)
        value, weight = F.lit(None), F.lit(1)
        if isinstance(d, Burst) and d.distinct:
            value = column(d.distinct)
        if isinstance(d, Burst) and d.total:
            numeric = d.total in s.names and isinstance(s[d.total].dataType, T.NumericType)
            weight = F.coalesce(F.col(d.total), F.lit(0)) if numeric else F.lit(0)
            below = F.raise_error(F.lit(f"{d.total}: amounts that a burst totals must not be negative"))
            weight = F.when(weight < 0, below.cast(amount)).otherwise(weight.cast(amount))
        entity = F.map_from_arrays(
            F.array(*(F.lit(f) for f in d.group_by)), F.array(*parts)
        )
        found.append(
            F.when(
                keyed & matched,
                F.struct(
                    F.lit(rule.id).alias("rule_id"),
                    F.concat_ws("|", *parts).alias("entity_key"),
                    entity.alias("entity"),
                    weight.cast(amount).alias("amount"),
                    value.cast("string").alias("counted"),
                    mask.alias("mask"),
                ),
            )
        )
    position = (
        F.col("tie").cast("bigint")
        if "tie" in s.names
        else schema.position(column("feed_order"), column("line_no"))
    )
    # the partition id, never negative, keeps the optimizer from repeating the predicates
    # in a filter below the explode
    hits = F.filter(F.array(*found), lambda x: x.isNotNull() & (F.spark_partition_id() >= 0))
    return (
        events.withColumns({"t": times.micros(F.col("ts")), "tie": position, "_hits": hits})
        .withColumn("_hit", F.explode("_hits"))
        .select(*s.names, *([] if "tie" in s.names else ["tie"]), "t", "_hit.*")
    )


def _of(kind: type, rules: Seq[Rule]) -> list[Rule]:
    return [r for r in rules if isinstance(r.detect, kind)]


def _only(hits: DataFrame, rules: Seq[Rule]) -> DataFrame:
    return hits.filter(F.col("rule_id").isin([r.id for r in rules])).withColumn(
        "w", per_rule({r.id: window_micros(r) for r in rules}, "bigint")
    )


def burst_labels(hits: DataFrame, rules: Seq[Rule], hot: DataFrame | None = None) -> DataFrame:
    """Ticks inside the bursts of the burst rules among `rules`, from fanned-out hits."""
    rules = _of(Burst, rules)
    wanted = _only(hits, rules).withColumns(
        {
            "need": per_rule({r.id: r.detect.count for r in rules}, "bigint"),
            "counts_values": per_rule(
                {r.id: r.detect.distinct is not None for r in rules}, "boolean"
            ),
        }
    )
    return burst.labels(wanted, hot)


def sequence_labels(hits: DataFrame, rules: Seq[Rule], hot: DataFrame | None = None) -> DataFrame:
    """Rows inside the sequences of the sequence rules among `rules`, from fanned-out hits."""
    rules = _of(Sequence, rules)
    needs = {r.id: [step.count for step in r.detect.steps] for r in rules}
    return sequence.labels(_only(hits, rules), needs, hot)


def travel_pairs(
    hits: DataFrame, rules: Seq[Rule], geo: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Pairs of the travel rules among `rules`, from fanned-out hits."""
    rules = _of(Travel, rules)
    wanted = _only(hits, rules).withColumns(
        {
            "min_km": per_rule({r.id: r.detect.min_km for r in rules}, "double"),
            "min_kmh": per_rule({r.id: r.detect.min_kmh for r in rules}, "double"),
        }
    )
    return travel.pairs(wanted, geo, hot)


def pair_labels(pairs: DataFrame) -> DataFrame:
    """Both rows of each pair, with its span."""
    ends = F.array(
        F.struct(F.col("s_t").alias("t"), F.col("s_tie").alias("tie")),
        F.struct(F.col("e_t").alias("t"), F.col("e_tie").alias("tie")),
    )
    return pairs.select(*MATCH, "e_t", "e_tie", F.explode(ends).alias("at")).select(
        *KEY, "at.*", "s_t", "s_tie", "e_t", "e_tie"
    )


def labelled(hits: DataFrame, labels: DataFrame, rules: Seq[Rule]) -> DataFrame:
    """Hits at the labelled places, with the span of each label. `labels` come from staged tables.

    Labels are narrow and often few: Spark then sends them to the hits, which stay where they
    are. Many labels first thin out the hits by a bitmap of (rule, key, window), before any
    column of theirs is shuffled.
    """
    on = [c for c in labels.columns if c not in ("s_t", "s_tie", "e_t", "e_tie")]
    rows = _only(hits, rules)
    if staged_bytes(labels) > MANY_BYTES:
        w = per_rule({r.id: window_micros(r) for r in rules}, "bigint")
        place = ["rule_id", "entity_key", F.floor(F.col("t") / F.col("w"))]
        marks = membership.bitmap(labels.withColumn("w", w), place)
        rows = membership.maybe_in(rows, place, marks)
    return rows.drop("w").join(labels, on).select(
        *hits.columns, "s_t", "s_tie", "e_t", "e_tie"
    )


def evidence(
    events: DataFrame,
    rules: Seq[Rule],
    geo: DataFrame | None = None,
    pairs: DataFrame | None = None,
    hits: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per event of each match, with the match's span (s_t .. e_tie).

    `pairs` gives the travel pairs, `hits` the fan-out of the events (staged, so that
    they are read once) and `hot` their keys with very many rows, where they are known already.
    """
    if hits is None:
        hits = staged(fan_out(events, rules))
        hot = blocks.hot_keys(hits)
    parts = []
    if _of(Burst, rules):
        found = staged(burst_labels(hits, rules, hot))
        parts.append(labelled(hits, found, _of(Burst, rules)))
    if _of(Sequence, rules):
        found = staged(sequence_labels(hits, rules, hot))
        parts.append(labelled(hits, found, _of(Sequence, rules)))
    if _of(Travel, rules):
        if pairs is None:
            place = G.shipped_geo(events.sparkSession) if geo is None else geo
            pairs = staged(travel_pairs(hits, rules, place, hot))
        parts.append(labelled(hits, pair_labels(pairs), _of(Travel, rules)))
    if not parts:
        raise ValueError("no rule is armed")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rollup(names: set[str]) -> list[Column]:
    """Aggregates over evidence rows that matches and alerts share."""
    at = F.struct("t", "tie")

    def last(name: str, missing: str) -> Column:
        if name not in names:
            return F.lit(missing).alias(f"last_{name}")
        text = F.col(name).cast("string")
        known = F.coalesce(text != "", F.lit(False))
        return F.coalesce(
            F.max_by(F.when(known, text), F.when(known, at)), F.lit(missing)
        ).alias(f"last_{name}")

    return [
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        last("user", "an unknown account"),
        last("host", "an unknown host"),
    ]


def matches(rows: DataFrame, rules: Seq[Rule]) -> DataFrame:
    """One row per match, rolled up from its evidence.

    n, first_t, last_t, last_user, last_host, entity, total (summed amount),
    distinct_values, step_hits (rows per step, first step first).
    """
    longest = max(
        (len(r.detect.steps) for r in _of(Sequence, rules)), default=0
    )
    extra = [
        F.min_by("entity", F.struct("t", "tie")).alias("entity"),
        F.sum("amount").alias("total"),
        F.array(
            *(
                F.sum(F.when(sequence.matches_step(F.col("mask"), back), 1).otherwise(0))
                for back in range(longest)
            )
        ).cast("array<bigint>").alias("hits_from_last"),
    ]
    if any(r.detect.distinct for r in _of(Burst, rules)):
        extra.append(F.count_distinct("counted").alias("distinct_values"))
    else:
        extra.append(F.lit(None).cast("bigint").alias("distinct_values"))
    rolled = rows.groupBy(*MATCH).agg(*_rollup(set(rows.columns)), *extra)
    return rolled.withColumn("w", per_rule({r.id: window_micros(r) for r in rules}, "bigint"))


def with_times(rows: DataFrame) -> DataFrame:
    """first_seen and last_seen timestamps in place of first_t and last_t."""
    return rows.withColumns(
        {
            "first_seen": F.timestamp_micros("first_t"),
            "last_seen": F.timestamp_micros("last_t"),
        }
    ).drop("first_t", "last_t")


# Placeholder -> (evidence column, how many values). Fixed values.
LISTED = {"users": ("user", 6), "ports": ("port", 12), "paths": ("path", 4)}


def _placeholders(rules: Seq[Rule]) -> set[str]:
    return {name for r in rules for name in re.findall(r"\{(\w+)\}", r.narrative)}


def _narratives(rules: Seq[Rule], has_pairs: bool) -> Column:
    """Headline per alert row.

    With one match: its entity, then its own values. With several: values of the merged
    evidence, then the entity, then the own values of the last match.
    """
    common = {
        "count": F.col("n"),
        "span": times.human_span(F.floor((F.col("last_t") - F.col("first_t")) / 1000)),
        "user": F.col("last_user"),
        "host": F.col("last_host"),
        **{name: F.coalesce(F.col(name), F.lit("")) for name in LISTED},
    }
    merged = F.col("n_matches") > 1
    headline = F.lit(None).cast("string")
    for rule in rules:
        d = rule.detect
        own: dict[str, Column] = {}
        if isinstance(d, Burst) and d.distinct:
            own["distinct"] = F.col("last.distinct_values")
        if isinstance(d, Burst) and d.total:
            own["sum"] = F.col("last.total")
            own["mb"] = net.megabytes(F.col("last.total"))
        if isinstance(d, Sequence):
            for k, step in enumerate(d.steps):
                own[step.label] = F.get(
                    F.col("last.hits_from_last"), F.lit(len(d.steps) - 1 - k)
                )
        if isinstance(d, Travel) and has_pairs:
            pair = F.col("pair")
            own |= {
                "from": F.concat(pair["from_city"], F.lit(", "), pair["from_cc"]),
                "to": F.concat(pair["to_city"], F.lit(", "), pair["to_cc"]),
                "from_ip": pair["from_ip"],
                "to_ip": pair["to_ip"],
                "km": F.floor(pair["km"] + 0.5),
                "kmh": F.floor(pair["kmh"] + 0.5),
                "gap": times.human_span(F.floor(pair["gap"] / 1000)),
            }

        def value_of(name: str, d=d, own=own) -> Column | None:
            entity = F.col("entity")[name] if name in d.group_by else None
            alone = [c for c in (entity, own.get(name), common.get(name)) if c is not None]
            folded = [c for c in (common.get(name), entity, own.get(name)) if c is not None]
            if not alone:
                return None
            texts = lambda cs: F.coalesce(*(c.cast("string") for c in cs))
            return F.when(merged, texts(folded)).otherwise(texts(alone))

        headline = F.when(
            F.col("rule_id") == rule.id, X.template(rule.narrative, value_of)
        ).otherwise(headline)
    return headline


def alert_id(rule_id: Column, entity_key: Column, first_t: Column) -> Column:
    return F.concat_ws("::", rule_id, entity_key, F.floor(first_t / 1000).cast("string"))


def alert_matches(
    rows: DataFrame, rules: Seq[Rule], hot: DataFrame | None = None
) -> DataFrame:
    """Matches with the alert they fold into (alert_t). `hot` names keys with very many rows."""
    return correlate.with_alert(matches(rows, rules), hot)


def alert_evidence(rows: DataFrame, own: DataFrame, rules: Seq[Rule]) -> DataFrame:
    """Evidence rows with the alert they belong to (alert_t, alert_id).

    `own` is alert_matches. A row that several matches of an alert share is kept for the
    first of them. That can only happen to sequences and travel: a burst takes all rows
    of a time or none.
    """
    labelled = rows.join(own.select(*MATCH, "alert_t"), MATCH)
    sharing = [r.id for r in rules if not isinstance(r.detect, Burst)]
    if sharing and "raw" not in rows.columns:
        raise ValueError("events need a `raw` column, by which shared evidence of sequences and travel is told")
    if sharing:
        shared = F.col("rule_id").isin(sharing)
        once = correlate.unseen_evidence(labelled.filter(shared))
        bursts = labelled.filter(~shared)
        labelled = bursts.unionByName(once) if len(sharing) < len(rules) else once
    return labelled.withColumn(
        "alert_id", alert_id(F.col("rule_id"), F.col("entity_key"), F.col("alert_t"))
    )


def alerts(
    kept: DataFrame,
    own: DataFrame,
    rules: Seq[Rule],
    pairs: DataFrame | None = None,
) -> DataFrame:
    """One row per alert, in the alert schema.

    `kept` is alert_evidence and `own` alert_matches; `pairs` (the travel pairs) fills
    the place values of travel headlines.
    """
    if pairs is not None:
        place = pairs.select(
            *MATCH,
            F.struct(
                "from_ip", "to_ip", "from_city", "from_cc", "to_city", "to_cc", "km", "kmh",
                (F.col("e_t") - F.col("s_t")).alias("gap"),
            ).alias("pair"),
        )
        own = own.join(place, MATCH, "left")
    order = F.struct("first_t", "s_t", "s_tie")
    last_columns = ["distinct_values", "total", "hits_from_last"] + (
        ["pair"] if pairs is not None else []
    )
    folded = own.groupBy(*ALERT).agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.min_by("entity", order).alias("entity"),
        F.max_by(F.struct(*last_columns), order).alias("last"),
    )
    if pairs is not None:
        folded = folded.withColumn("pair", F.col("last.pair"))
    names = set(kept.columns)
    rolled = kept.groupBy(*ALERT).agg(*_rollup(names))
    out = folded.join(rolled, ALERT)
    needed = _placeholders(rules)
    lists = {
        name: (
            F.col(c) if c == "port" else X.nonempty(F.col(c).cast("string")), n
        )
        for name, (c, n) in LISTED.items()
        if name in needed and c in names
    }
    if "source" in names:
        lists["sources"] = (F.col("source"), None)
    if lists:
        out = out.join(correlate.first_values(kept, ALERT, lists), ALERT, "left")
    for name in LISTED:
        text = F.array_join(name, ", ") if name in lists else F.lit("")
        out = out.withColumn(name, text)
    if "sources" not in lists:
        out = out.withColumn("sources", F.array().cast("array<string>"))
    return described(out, rules, pairs is not None)


def described(rolled: DataFrame, rules: Seq[Rule], has_pairs: bool) -> DataFrame:
    """Alerts with headline, id and what is known about their rule, in the alert schema.

    `rolled`: rule_id, entity_key, alert_t, entity, n_matches, last (values of the last match),
    n, first_t, last_t, last_user, last_host, users, ports and paths (as text), sources, and pair
    if `has_pairs`.
    """
    named = rolled.withColumns(
        {
            "narrative": _narratives(rules, has_pairs),
            "alert_id": alert_id(F.col("rule_id"), F.col("entity_key"), F.col("alert_t")),
        }
    )
    about = {
        "rule_name": "name", "severity": "severity", "mitre_id": "mitre_id",
        "mitre_name": "mitre_name", "description": "description",
    }
    named = named.withColumns(
        {
            c: per_rule({r.id: getattr(r, attr) for r in rules}, "string")
            for c, attr in about.items()
        }
    )
    return with_times(named).select(
        "alert_id", "rule_id", *about, "entity", "entity_key",
        "first_seen", "last_seen", "narrative",
        F.col("n").alias("evidence_count"), "n_matches", "sources",
    )


def detect(
    events: DataFrame, rules: Seq[Rule], geo: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Alerts, and their evidence with alert_id, of the enabled rules.

    Hits, match evidence and matches are staged as Parquet in the checkpoint folder: they are smaller
    than the events, and several results read them.
    """
    rules = [r for r in rules if r.enabled]
    pairs = None
    hits = staged(fan_out(events, rules))
    hot = blocks.hot_keys(hits)
    if _of(Travel, rules):
        place = G.shipped_geo(events.sparkSession) if geo is None else geo
        pairs = staged(travel_pairs(hits, rules, place, hot))
    rows = staged(evidence(events, rules, pairs=pairs, hits=hits, hot=hot))
    own = staged(alert_matches(rows, rules, hot))
    kept = alert_evidence(rows, own, rules)
    return alerts(kept, own, rules, pairs), kept


def recent_evidence(rows: DataFrame, n: int = 14) -> DataFrame:
    """The last n evidence rows of each alert, oldest first within the alert."""
    from pyspark.sql import Window

    newest = Window.partitionBy("alert_id").orderBy(F.desc("t"), F.desc("tie"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
