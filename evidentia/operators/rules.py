"""Incremental rule scan: unscanned messages, keyword matches, candidates, evidence, state."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import constants as K
from evidentia.functions import canonical_json, compact, digest_of


class RuleError(ValueError):
    """The stored rule does not allow this scan."""


@dataclass(frozen=True)
class Rule:
    """Literal keywords per event type. ``combined`` names a message that matches all types."""

    id: str
    version: str
    event_types: dict[str, list[str]]
    combined: str
    name: str = ""
    policy: dict[str, str] = field(default_factory=lambda: {"review_policy": "REVIEW_REQUIRED", "time_policy": "unresolved"})

    def definition(self) -> dict:
        return {"event_types": self.event_types, **self.policy}

    def definition_json(self) -> str:
        return json.dumps(self.definition(), ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def row(self, spark: SparkSession, enabled: bool = True) -> DataFrame:
        return spark.createDataFrame(
            [(self.id, self.name, self.version, enabled, self.definition_json())],
            "rule_id string, name string, rule_version string, enabled boolean, definition_json string",
        )


def default_rule() -> Rule:
    fixed = K.SIGNUP_DEADLINE_RULE
    return Rule(fixed["id"], fixed["version"], fixed["event_types"], fixed["combined"], fixed["name"])


def rule_verdicts(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``rule_id, verdict``: NEW, READY, DEFINITION_DIFFERS or DISABLED."""
    old = stored.select(
        "rule_id",
        F.col("rule_version").alias("_version"),
        F.col("enabled").alias("_enabled"),
        canonical_json("definition_json").alias("_definition"),
    )
    same = F.col("_version").eqNullSafe(F.col("rule_version")) & F.col("_definition").eqNullSafe(
        canonical_json("definition_json")
    )
    return current.join(old, "rule_id", "left").select(
        "rule_id",
        F.when(F.col("_version").isNull(), "NEW")
        .when(~same, "DEFINITION_DIFFERS")
        .when(~F.col("_enabled"), "DISABLED")
        .otherwise("READY")
        .alias("verdict"),
    )


def check_rule(stored: DataFrame, rule: Rule) -> None:
    """Refuse to scan under a changed or disabled rule. Reads the one row of this rule."""
    mine = stored.filter(F.col("rule_id") == rule.id)
    verdict = rule_verdicts(mine, rule.row(stored.sparkSession)).first()["verdict"]
    if verdict in ("DEFINITION_DIFFERS", "DISABLED"):
        raise RuleError(f"rule {rule.id}: {verdict}; use a new rule version")


def select_unscanned(messages: DataFrame, state: DataFrame, rule_id: str, cap: int | None = None) -> DataFrame:
    """Messages without a state row for the rule, oldest first when capped.

    Only ids and instants are sorted for the cap; bodies are joined afterwards.
    """
    done = state.filter(F.col("rule_id") == rule_id).select("message_id")
    open_rows = messages.join(done, "message_id", "left_anti")
    if cap is None:
        return open_rows
    chosen = open_rows.select("sent_at", "message_id").orderBy("sent_at", "message_id").limit(cap)
    return open_rows.join(chosen.select("message_id"), "message_id", "left_semi")


def scan_progress(messages: DataFrame, state: DataFrame, rule_id: str, cap: int) -> DataFrame:
    """``scanned, remaining, status`` of a capped scan, counted without sorting."""
    total = select_unscanned(messages.select("message_id"), state, rule_id).agg(F.count("*").alias("outstanding"))
    scanned = F.least(F.col("outstanding"), F.lit(cap))
    return total.select(
        scanned.alias("scanned_messages"),
        (F.col("outstanding") - scanned).alias("remaining_messages"),
        F.when(F.col("outstanding") > cap, "partial").otherwise("complete").alias("status"),
    )


def message_bodies(parts: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Part texts of a message joined by newline in part order."""
    texts = parts.filter(F.col("text_content").isNotNull())
    if keys is not None:
        texts = texts.join(keys.select("message_id"), "message_id", "left_semi")
    gathered = texts.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("part_index", "text_content"))).alias("_texts")
    )
    return gathered.select("message_id", F.array_join(F.transform("_texts", lambda t: t["text_content"]), "\n").alias("body"))


def body_of_parts(parts: str | Column) -> Column:
    """The same body from parts nested in the message row; needs no shuffle."""
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text_content"]), lambda t: t.isNotNull()), "\n")


def matched_keywords(body: str, rule: Rule) -> Column:
    """``map<event_type, array<keyword>>`` of the types with at least one hit.

    The keywords are literals of the plan, so matching stays in generated code.
    """
    text = F.col(body)
    hits = [
        F.struct(
            F.lit(event_type).alias("key"),
            F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)).alias("value"),
        )
        for event_type, words in rule.event_types.items()
    ]
    return F.map_from_entries(F.filter(F.array(*hits), lambda e: F.size(e["value"]) > 0))


def combine_types(matches: str | Column, rule: Rule) -> Column:
    """All types together give the combined one, else the first type in rule order."""
    keys = F.map_keys(matches)
    types = list(rule.event_types)
    every = F.size(F.array_except(F.array(*[F.lit(t) for t in types]), keys)) == 0
    result = F.when(every, F.lit(rule.combined)) if len(types) > 1 else F.when(F.lit(False), F.lit(""))
    for event_type in types:
        result = result.when(F.array_contains(keys, event_type), F.lit(event_type))
    return result


def compact_title(body: str | Column) -> Column:
    short = compact(body, K.TITLE_CHARS)
    return F.when(short != "", short).otherwise(F.lit(K.NO_TEXT_TITLE))


def match_rules(bodies: DataFrame, rule: Rule) -> DataFrame:
    """Adds matches, event type, title and the candidate key; unmatched rows keep nulls."""
    matched = bodies.withColumn("matches", matched_keywords("body", rule)).withColumn(
        "event_type", combine_types("matches", rule)
    )
    key = digest_of(F.col("message_id"), F.col("event_type"))
    return (
        matched.withColumn("title", compact_title("body"))
        .withColumn("dedup_key", key)
        .withColumn("candidate_id", F.concat(F.lit("evt_"), F.substring(key, 1, K.CANDIDATE_HEX)))
    )


def candidate_rows(matched: DataFrame, rule: Rule, as_of: Column) -> DataFrame:
    """New candidate rows of a scan, with review defaults and a provenance rationale."""
    hits = matched.filter(F.col("event_type").isNotNull())
    extras = [F.col(c) for c in ("source_kind",) if c in matched.columns]
    rationale = F.to_json(
        F.struct(
            F.col("matches").alias("matched_keywords"),
            F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("message_timestamp"),
            F.lit(rule.id).alias("profile_id"),
            *extras,
            F.lit("NOT_ATTEMPTED_V1").alias("time_extraction"),
        )
    )
    return hits.select(
        "candidate_id",
        F.lit(rule.id).alias("rule_id"),
        "event_type",
        "title",
        F.lit("REVIEW_REQUIRED").alias("review_status"),
        as_of.alias("first_seen_at"),
        as_of.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("event_at"),
        F.lit(None).cast("timestamp").alias("deadline_at"),
        F.lit(True).alias("time_uncertain"),
        F.lit("normal").alias("importance"),
        "dedup_key",
        rationale.alias("rationale_json"),
    )


def merge_candidates(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or refresh last-seen, title and rationale; first-seen and review stay."""
    keys = ["rule_id", "dedup_key"]
    fresh = batch.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c not in keys]
    )
    joined = store.join(fresh, keys, "full")
    newest = {"last_seen_at", "title", "rationale_json"}
    columns = []
    for name in store.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in newest:
            columns.append(F.coalesce(f"_new_{name}", name).alias(name))
        else:
            known = F.col("candidate_id").isNotNull()
            columns.append(F.when(known, F.col(name)).otherwise(F.col(f"_new_{name}")).alias(name))
    return joined.select(*columns)


def evidence_rows(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("event_type").isNotNull()).select(
        "candidate_id", "message_id", F.lit("trigger").alias("evidence_role"), F.lit(0).cast("long").alias("evidence_order")
    )


def merge_evidence(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or ignore on (candidate, message)."""
    new = batch.dropDuplicates(["candidate_id", "message_id"]).join(
        store.select("candidate_id", "message_id"), ["candidate_id", "message_id"], "left_anti"
    )
    return store.unionByName(new)


def scan_state_rows(matched: DataFrame, rule: Rule, as_of: Column, run_id: str) -> DataFrame:
    """State rows of the scanned messages, matched or not."""
    return matched.select(
        F.lit(rule.id).alias("rule_id"),
        "message_id",
        as_of.alias("scanned_at"),
        F.col("event_type").isNotNull().alias("matched"),
        F.lit(run_id).alias("monitor_run_id"),
    )


def source_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """Per source: messages, newest message, last import; no live freshness is claimed."""
    messages = tables["messages"].groupBy("source_id").agg(
        F.count("*").alias("message_count"), F.max("sent_at").alias("latest_message_at")
    )
    runs = (
        tables["import_runs"].filter("status = 'complete'").groupBy("source_id")
        .agg(F.max("finished_at").alias("last_successful_import_at"))
    )
    sources = tables["sources"].select("source_id", F.col("kind").alias("source_kind"))
    return (
        sources.join(messages, "source_id", "left")
        .join(runs, "source_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
        .withColumn("collector_freshness_state", F.lit("NOT_RECORDED"))
    )


def monitor_run(
    state_rows: DataFrame, progress: DataFrame, rule: Rule, as_of: Column, run_id: str
) -> DataFrame:
    """The run record of a scan."""
    counted = state_rows.agg(F.count_if("matched").alias("candidate_count"))
    # both sides are single aggregate rows; a union folds them without a join
    both = progress.unionByName(counted, allowMissingColumns=True)
    columns = ("status", "scanned_messages", "candidate_count", "remaining_messages")
    return both.agg(*[F.max(c).alias(c) for c in columns]).select(
        F.lit(run_id).alias("monitor_run_id"),
        F.lit(rule.id).alias("rule_id"),
        as_of.alias("started_at"),
        as_of.alias("finished_at"),
        *columns,
    )


def scan_messages(
    messages: DataFrame, state: DataFrame, rule: Rule, cap: int | None = None
) -> DataFrame:
    """Unscanned messages with their matches; ``messages`` carry ``body`` or nested ``parts``.

    All of them, unless ``cap`` names how many of the oldest to take in one run.
    """
    if cap is not None and (type(cap) is not int or cap < 1):
        raise RuleError("cap must be a positive integer, or None for everything")
    chosen = select_unscanned(messages, state, rule.id, cap)
    if "body" not in chosen.columns:
        chosen = chosen.withColumn("body", body_of_parts("parts"))
    return match_rules(chosen, rule)


# --- many rules at once ---------------------------------------------------------------

#: Keywords that one pass looks for; a table of rules beyond it is an error, not a slow plan.
MOST_KEYWORDS = 100_000

RULE_TABLE = "rule_id string, type_position int, event_type string, keyword_position int, keyword string, combined string"
RULE_MATCHES = "array<struct<rule_id:string,event_type:string,matches:array<struct<key:string,value:array<string>>>>>"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows of RULE_TABLE, one for each keyword."""
    rows = [
        (r.id, i, event_type, j, word, r.combined)
        for r in rules
        for i, (event_type, words) in enumerate(r.event_types.items())
        for j, word in enumerate(words)
    ]
    return spark.createDataFrame(rows, RULE_TABLE)


class Matcher:
    """All keywords of all rules in one automaton, which goes over a text once however many there are."""

    def __init__(self, rows: list[tuple]):
        self.types: dict[str, list[str]] = {}
        self.combined: dict[str, str] = {}
        self.owners: dict[str, list[tuple[str, str, int]]] = {}
        for rule, _, event_type, at, word, combined in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
            types = self.types.setdefault(rule, [])
            if event_type not in types:
                types.append(event_type)
            self.combined[rule] = combined
            self.owners.setdefault(word, []).append((rule, event_type, at))
        self.always = self.owners.pop("", [])
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for word in self.owners:
                self._automaton.add_word(word, word)
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, body: str | None) -> list[dict]:
        """For each rule with a hit: its event type, and its types with the keywords found, in the rule's order."""
        if body is None:
            return []
        found = {word for _, word in self.automaton().iter(body)} if self.owners else set()
        hits: dict[str, dict[str, list[tuple[int, str]]]] = {}
        for word, owners in [("", self.always), *((w, self.owners[w]) for w in found)]:
            for rule, event_type, at in owners:
                hits.setdefault(rule, {}).setdefault(event_type, []).append((at, word))
        out = []
        for rule, by_type in hits.items():
            types = [t for t in self.types[rule] if t in by_type]
            every = len(self.types[rule]) > 1 and len(types) == len(self.types[rule])
            value = [{"key": t, "value": [w for _, w in sorted(by_type[t])]} for t in types]
            out.append({"rule_id": rule, "event_type": self.combined[rule] if every else types[0], "matches": value})
        return out


def match_rule_table(bodies: DataFrame, table: DataFrame, key: str = "message_id", body: str = "body") -> DataFrame:
    """Each message and rule with at least one keyword: ``key, rule_id, event_type, matches``, as `match_rules` gives them.

    ``table`` has the columns of RULE_TABLE. It is read once and its size checked; tasks share it as one automaton, so
    the plan does not grow with the rules, and each body is read once for all of them.
    """
    rows = [tuple(r) for r in table.select(*[c.split()[0] for c in RULE_TABLE.split(", ")]).limit(MOST_KEYWORDS + 1).collect()]
    if len(rows) > MOST_KEYWORDS:
        raise RuleError(f"a rule table has at most {MOST_KEYWORDS} keywords")
    shared = bodies.sparkSession.sparkContext.broadcast(Matcher(rows))

    @F.pandas_udf(RULE_MATCHES)
    def look(texts: pd.Series) -> pd.Series:
        matcher = shared.value
        return pd.Series([matcher.matches(x) for x in texts])

    found = bodies.select(key, F.explode(look(F.col(body))).alias("hit"))
    return found.select(key, "hit.rule_id", "hit.event_type", F.map_from_entries("hit.matches").alias("matches"))
