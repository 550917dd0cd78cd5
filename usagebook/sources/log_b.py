"""Session logs of client B: tagged records whose usage is a cumulative counter.

`records` reads each line by itself, `observations` folds a log's lines in order
(operators/ordered.py divides long logs); streaming/logs.py has the same fold
record by record. Only identifiers, settings, times and counters are read; prompts,
answers and names of unknown fields never leave the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagebook.functions.ids import digest, pseudonym, stable_id
from usagebook.functions.tables import written
from usagebook.functions.values import rfc3339
from usagebook.operators.ordered import FLAGS, SEGMENT, SNAPSHOT, once_per_key, running, snapshot_deltas
from usagebook.sources.common import field, fields, file_lines, listed_files, parsed, prefer_plain, some_rows

CLIENT = "openai_codex"
PATTERN = "rollout-*.jsonl{,.zst}"
_INFO, _T = "$.payload.info", "$.payload.info.total_token_usage"
#: Counters and the names under which versions of the client report them; the first name that is present counts (fixed values).
COUNTERS = {
    "input_tokens": ("input_tokens",), "cached_tokens": ("cached_input_tokens",), "output_tokens": ("output_tokens",), "reasoning_tokens": ("reasoning_output_tokens",), "total_tokens": ("total_tokens",),
    "w5m": ("cache_write_5m_tokens", "cache_creation_5m_input_tokens"), "w1h": ("cache_write_1h_tokens", "cache_creation_1h_input_tokens"),
    "writes": ("cache_write_tokens", "cache_write_input_tokens", "cache_creation_input_tokens"),
}
#: Fields of the usage envelope (fixed values).
ENVELOPE = ("total_token_usage", "last_token_usage", "model_context_window")
#: What is read of a record's payload, and of the settings in it.
_PAYLOAD = ("type", "id", "thread_id", "session_id", "cli_version", "model", "model_provider", "model_provider_id", "service_tier", "auth_mode", "info", "thread_settings")
_SETTINGS = ("model", "model_provider", "model_provider_id", "service_tier", "auth_mode")
#: What a turn's context or a change of settings states, each by the names that it may have.
_STATED = (("model",), ("model_provider", "model_provider_id"), ("service_tier",), ("auth_mode",))
#: Record types that hold no usage (fixed values).
IGNORED = ("response_item", "compacted", "world_state", "inter_agent_communication", "inter_agent_communication_metadata")
#: Codes that a log gets once, at the first line that calls for them; unknown fields and types once each.
ONCE = (
    "codex_blank_record", "codex_primary_session_meta_missing", "codex_missing_client_version", "codex_invalid_context_window", "codex_usage_without_session_meta", "codex_usage_without_model_context",
    "codex_format_drift", "codex_unknown_record_type",
)
#: What can be said of one observation, in this order.
NOTES = (
    "cached_input_not_fully_reported", "cache_write_not_reported", "reasoning_output_not_fully_reported", "input_subsets_exceed_total_input", "reasoning_output_exceeds_output",
    "total_tokens_not_component_additive", "auth_mode_inferred_from_current_profile",
)


def _counter(names: tuple[str, ...]) -> tuple[Column, Column]:
    """The counter under the first name that is present (null if that holds null), and whether it holds something else."""
    kind, number = [field("_counts", n, "kind") for n in names], [field("_counts", n, "number") for n in names]
    chosen_kind, chosen = kind[-1], number[-1]
    for k, v in zip(reversed(kind[:-1]), reversed(number[:-1]), strict=True):
        chosen_kind, chosen = F.when(k.isNotNull(), k).otherwise(chosen_kind), F.when(k.isNotNull(), v).otherwise(chosen)
    return chosen, F.coalesce((chosen_kind != "VOID") & chosen.isNull(), F.lit(False))


def _unknown(of: str, known: tuple[str, ...], scope: str) -> Column:
    """The fingerprint of an object's unknown fields, which tells sets of them apart and shows none; null without any."""
    extra = F.array_sort(F.array_except(of, F.array(*[F.lit(k) for k in known])))
    return F.when(F.size(extra) > 0, digest(F.lit("unknown-fields"), F.lit(scope), F.array_join(extra, "\x1f")))


def records(lines: DataFrame) -> DataFrame:
    """One row a line that says something: meta, model, provider, tier, auth, window (where stated), now (a valid snapshot), and codes, pairs of a warning's code and key."""
    names = tuple(x for own in COUNTERS.values() for x in own)
    keys = lambda path: F.map_keys(F.try_variant_get("v", path, "map<string, variant>"))
    located = [c for c in ("byte_start", "byte_end") if c in lines.columns]
    p = parsed(lines).select(
        "source_id", "path", "line_number", *located, F.col("text").rlike(r"(?U)^\s*$").alias("_blank"), F.col("v").isNull().alias("_malformed"),
        fields("v", "$", ("type", "timestamp")).alias("_top"), fields("v", "$.payload", _PAYLOAD).alias("_payload"), fields("v", "$.payload.thread_settings", _SETTINGS).alias("_settings"),
        keys(_INFO).alias("_info"), fields("v", _INFO, ENVELOPE).alias("_envelope"), keys(_T).alias("_fields"), fields("v", _T, names).alias("_counts"),
    )
    # the steps below are selections of their own: what one names is computed once, however often the next ones use it
    text = lambda of, *n: F.coalesce(*[field(of, x) for x in n])
    present = lambda of, n: field(of, n, "kind").isNotNull()
    counts = {name: _counter(own) for name, own in COUNTERS.items()}
    p = p.select(
        "source_id", "path", "line_number", *located, "_blank", "_malformed", "_info", "_fields", F.col("_top").isNotNull().alias("_object"), F.col("_payload").isNotNull().alias("_held"), F.col("_settings").isNotNull().alias("_set"),
        field("_top", "type").alias("_type"), field("_payload", "type").alias("_event"), rfc3339(field("_top", "timestamp")).alias("occurred_at"), F.lower(text("_payload", "id", "thread_id")).alias("_thread"),
        *[field("_payload", n).alias(f"_{n}") for n in ("session_id", "cli_version")], *[F.struct(text(of, *n).alias("v"), present(of, n[0]).alias("said")).alias(f"{of}_{n[0]}") for of in ("_payload", "_settings") for n in _STATED],
        *[field("_envelope", n, "kind").alias(f"_k_{n}") for n in ENVELOPE], field("_envelope", "model_context_window", "number").alias("_window"), field("_payload", "info", "kind").alias("_k_info"),
        *[v.alias(f"_n_{k}") for k, (v, _) in counts.items()], *[bad.alias(f"_b_{k}") for k, (_, bad) in counts.items()],
    )
    of = lambda name: F.coalesce(F.col("_type") == name, F.lit(False))
    says = lambda name: F.coalesce(of("event_msg") & F.col("_held") & (F.col("_event") == name), F.lit(False))
    p = p.withColumns({"_meta": of("session_meta"), "_turn": of("turn_context"), "_message": of("event_msg"), "_applied": says("thread_settings_applied"), "_token": says("token_count") & F.col("_info").isNotNull()})
    n = {k: F.col(f"_n_{k}") for k in COUNTERS}
    bad = F.exists(F.array(*[F.col(f"_b_{k}") for k in COUNTERS]), lambda x: x) | n["input_tokens"].isNull() | n["output_tokens"].isNull()
    p = p.withColumns({
        "_usage": F.col("_token") & F.col("_fields").isNotNull(), "_bad": bad, "_specific": n["w5m"].isNotNull() | n["w1h"].isNotNull(), "_bad_window": F.col("_token") & (F.col("_k_model_context_window") != "VOID") & F.col("_window").isNull(),
        "_strange_info": F.when(F.col("_token"), _unknown("_info", ENVELOPE, "token_info")), "_strange_usage": F.when(F.col("_token"), _unknown("_fields", names, "total_token_usage")),
    })
    zero = lambda c: F.coalesce(c, F.lit(0))
    now = F.struct(
        n["input_tokens"].alias("input_tokens"), n["output_tokens"].alias("output_tokens"), F.coalesce(n["total_tokens"], n["input_tokens"] + n["output_tokens"]).alias("total_tokens"), zero(n["cached_tokens"]).alias("cached_tokens"),
        zero(n["reasoning_tokens"]).alias("reasoning_tokens"), zero(n["w5m"]).alias("w5m"), zero(n["w1h"]).alias("w1h"), F.when(F.col("_specific"), 0).otherwise(zero(n["writes"])).cast("long").alias("w_other"),
        n["cached_tokens"].isNotNull().alias("cached_reported"), n["reasoning_tokens"].isNotNull().alias("reasoning_reported"), (F.col("_specific") | n["writes"].isNotNull()).alias("writes_reported"),
    )
    held, token = F.col("_held"), F.col("_token")
    line = (  # what a line as a whole is
        F.when(F.col("_blank"), "codex_blank_record").when(F.col("_malformed"), "codex_malformed_record").when(~F.col("_object"), "codex_non_object_record").when(F.col("_type").isNull(), "codex_missing_record_type")
        .when(F.col("_meta") & ~held, "codex_invalid_session_meta").when(F.col("_turn") & ~held, "codex_invalid_turn_context").when(F.col("_message") & ~held, "codex_invalid_event_message")
        .when(F.col("_message") & F.col("_event").isNull(), "codex_missing_event_type").when(F.col("_applied") & ~F.col("_set"), "codex_invalid_thread_settings")
        .when(~F.col("_type").isin("session_meta", "turn_context", "event_msg", *IGNORED), "codex_unknown_record_type")
        .when(says("token_count") & (F.col("_k_info") != "VOID") & F.col("_info").isNull(), "codex_invalid_token_info").when(token & F.col("_k_total_token_usage").isNull(), "codex_missing_cumulative_usage")
        .when(token & F.col("_fields").isNull(), "codex_invalid_cumulative_usage").when(F.col("_usage") & F.col("_bad"), "codex_unsupported_usage_schema")
    )
    p = p.withColumn("_line", line)
    warn = lambda code, key=None: F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(None).cast("string") if key is None else key).alias("key"))
    codes = F.array_compact(F.array(
        F.when(F.col("_line").isNotNull(), warn(F.col("_line"), F.when(F.col("_line") == "codex_unknown_record_type", digest(F.lit("unknown-type"), F.col("_type"))))), F.when(F.col("_bad_window"), warn("codex_invalid_context_window")),
        F.when(F.col("_strange_info").isNotNull(), warn("codex_format_drift", F.col("_strange_info"))), F.when(F.col("_strange_usage").isNotNull(), warn("codex_format_drift", F.col("_strange_usage"))),
    ))
    p = p.withColumn("_codes", codes)
    said = lambda name: F.when(F.col("_turn"), F.col(f"_payload_{name}")).when(F.col("_applied"), F.col(f"_settings_{name}"))
    stated = lambda name: F.when(said(name)["said"], F.struct(said(name)["v"].alias("v")))
    own = F.struct(F.col("_thread").alias("thread"), F.col("_session_id").alias("session"), F.col("_cli_version").alias("version"), F.col("_payload_model_provider.v").alias("provider"), F.col("_payload_auth_mode.v").alias("auth"))
    row = {
        **{c: F.col(c) for c in ("source_id", "path", "line_number", *located, "occurred_at")}, "meta": F.when(F.col("_meta") & held, own), "model": said("model")["v"], "provider": said("model_provider")["v"], "tier": stated("service_tier"), "auth": stated("auth_mode"),
        "window": F.when(token & F.col("_k_model_context_window").isNotNull() & ~F.col("_bad_window"), F.struct(F.col("_window").alias("v"))), "now": F.when(F.col("_usage") & ~F.col("_bad"), now), "codes": F.col("_codes"),
    }
    told = [F.when(row[c].isNotNull(), True) for c in ("meta", "model", "provider", "tier", "auth", "window", "now")]
    return some_rows(p, row, (F.size("_codes") > 0) | F.coalesce(*told, F.lit(False)))


def file_thread(path: Column) -> Column:
    """The thread that a log's name ends with, if it does."""
    return F.lower(F.nullif(F.regexp_extract(path, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl(?:\.zst)?$", 1), F.lit("")))


def profile_root(path: Column) -> Column:
    """The folder above the nearest one of session logs, to which a profile belongs."""
    return F.nullif(F.regexp_extract(path, r"(?i)^(.*)/(?:sessions|archived_sessions)/", 1), F.lit(""))


def observations(lines: DataFrame, profiles: DataFrame | None = None, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Observations and warnings of client B's lines. profiles (root, auth_mode) fills in a way of authentication that no line has stated yet, marked as inferred."""
    rows = written(records(lines), "log-records")
    own = file_thread(F.col("path"))
    fits = F.col("meta").isNotNull() & F.coalesce(F.col("meta.thread") == own, F.lit(True))  # a log's own session record, not one copied from its parent
    at = F.col("line_number")
    ways = {
        "_meta": ("first", F.when(fits, F.struct(at.alias("line"), "meta.*"))), "_model": ("last", F.col("model")), "_provider": ("last", F.when(F.col("provider").isNotNull(), F.struct(at.alias("line"), F.col("provider").alias("v")))),
        "_tier": ("last", F.col("tier")), "_auth": ("last", F.when(F.col("auth").isNotNull(), F.struct(at.alias("line"), F.col("auth.v").alias("v")))), "_window": ("last", F.col("window")),
    }
    told = running(rows, ways, size=size, stored=True)
    meta = F.col("_meta")
    later = lambda c: F.coalesce(meta["line"] > F.col(c)["line"], meta.isNotNull())
    provider = F.when(later("_provider"), meta["provider"]).otherwise(F.col("_provider.v"))
    by_meta = later("_auth") & meta["auth"].isNotNull()
    auth = F.when(by_meta, meta["auth"]).otherwise(F.col("_auth.v"))
    session = F.when(meta.isNotNull(), F.coalesce(meta["session"], meta["thread"])).otherwise(F.lit(None).cast("string"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(\.zst)+$", "")
    counts = told.where("now is not null").select(
        "source_id", "path", "line_number", *[c for c in ("byte_start", "byte_end") if c in rows.columns], "occurred_at", "now", F.coalesce(session, own, name).alias("_session"), meta.isNotNull().alias("_known"), meta["version"].alias("client_version"),
        F.col("_model").alias("raw_model"), provider.alias("provider"), F.col("_tier.v").alias("service_tier"), auth.alias("auth_mode"), (by_meta | F.col("_auth").isNotNull()).alias("_auth_said"), F.col("_window.v").alias("context_window"),
    )
    deltas = snapshot_deltas(written(counts, "log-counts"), size=size)
    if profiles is not None:
        known = profiles.where("trim(auth_mode) <> ''").groupBy(F.col("root").alias("_root")).agg(F.min("auth_mode").alias("_profile"))
        deltas = deltas.withColumn("_root", profile_root(F.col("path"))).join(known, "_root", "left").drop("_root")
    else:
        deltas = deltas.withColumn("_profile", F.lit(None).cast("string"))
    deltas = written(judged(deltas), "log-deltas")
    return observed(deltas), _warned(rows, fits, deltas)


def judged(deltas: DataFrame) -> DataFrame:
    """Adds session_id, subsets, reasoning and additive, which say whether a delta's parts fit its totals, and inferred."""
    d = lambda c: F.col(f"delta.{c}")
    parts = d("cached_tokens") + d("w5m") + d("w1h") + d("w_other")
    inferred = ~F.col("_auth_said") & F.col("_profile").isNotNull()
    return deltas.withColumns({
        "session_id": pseudonym("ses", "session", F.col("_session")), "parts": parts, "subsets": parts <= d("input_tokens"), "reasoning": d("reasoning_tokens") <= d("output_tokens"),
        "additive": d("total_tokens") == d("input_tokens") + d("output_tokens"), "inferred": inferred, "auth_mode": F.when(inferred, F.col("_profile")).otherwise(F.col("auth_mode")),
    })


def observed(deltas: DataFrame) -> DataFrame:
    """The observations of judged deltas."""
    events = deltas.where("event")
    d = lambda c: F.col(f"delta.{c}")
    notes = [~d("cached_reported"), ~d("writes_reported"), ~d("reasoning_reported"), ~F.col("subsets"), ~F.col("reasoning"), ~F.col("additive"), F.col("inferred")]
    complete = d("cached_reported") & d("writes_reported") & d("reasoning_reported") & F.col("subsets") & F.col("reasoning") & ~F.col("inferred")
    boundary = F.concat_ws(":", *[F.col(f"now.{c}").cast("string") for c in SNAPSHOT])
    tier = F.lower(F.trim("service_tier"))
    source = lambda c, other="source_observed": F.when(F.col(c).isNotNull(), other)
    return events.select(
        "source_id", "line_number", *[c for c in ("byte_start", "byte_end") if c in events.columns], F.lit(CLIENT).alias("client"), stable_id(F.lit("counter-boundary"), F.col("session_id"), F.col("epoch").cast("string"), boundary).alias("event_key"),
        "session_id", F.col("event_index").alias("usage_event_index"), "occurred_at", "raw_model", F.coalesce("provider", F.lit("unknown")).alias("provider"),
        d("input_tokens").alias("input_tokens_total"), F.greatest(d("input_tokens") - F.col("parts"), F.lit(0)).alias("input_tokens_uncached"), d("cached_tokens").alias("input_tokens_cached"),
        d("w5m").alias("cache_write_5m_tokens"), d("w1h").alias("cache_write_1h_tokens"), d("w_other").alias("cache_write_unknown_tokens"), d("output_tokens").alias("output_tokens_total"), d("reasoning_tokens").alias("reasoning_output_tokens"),
        F.lit(0).cast("long").alias("web_search_requests"), F.lit(0).cast("long").alias("web_fetch_requests"), F.when(complete, "complete").otherwise("partial").alias("coverage"), F.lit(2).alias("quality_rank"),
        F.lit(None).cast("string").alias("warning"), F.array_compact(F.array(*[F.when(c, n) for n, c in zip(NOTES, notes, strict=True)])).alias("notes"),
        "auth_mode", F.when(F.col("inferred"), "current_profile_inferred").otherwise(source("auth_mode")).alias("auth_mode_provenance"), "service_tier", source("service_tier").alias("service_tier_provenance"),
        F.when(tier == "fast", "fast").when(tier.isin("default", "standard", "normal"), "standard").alias("speed"), F.lit(None).cast("string").alias("inference_geo"), "context_window",
        d("writes_reported").alias("cache_write_data_complete"), F.col("subsets").alias("input_subset_accounting_consistent"), "client_version",
    )


def _warned(rows: DataFrame, fits: Column, deltas: DataFrame) -> DataFrame:
    """(source_id, line_number, code): every warning of a log's lines, those of ONCE at their first line only."""
    pair = lambda code, key="": F.struct(F.lit(code).alias("code"), F.lit(key).alias("key"))
    by_line = rows.select("source_id", "line_number", F.explode("codes").alias("w"))
    metas = rows.where("meta is not null").select("source_id", "line_number", fits.alias("fits"), F.col("meta.version").isNull().alias("bare"))
    own = metas.where("fits").groupBy("source_id").agg(F.min("line_number").alias("_own"), F.min_by("bare", "line_number").alias("_bare"))
    early = metas.where("not fits").groupBy("source_id").agg(F.min("line_number").alias("line_number")).join(own.select("source_id", "_own"), "source_id", "left").where("_own is null or line_number < _own")
    bare = own.where("_bare").select("source_id", F.col("_own").alias("line_number"))
    event = F.col("event")
    found = F.array_compact(F.array(
        F.when(F.col("reset"), pair("codex_counter_reset")), F.when(F.col("billable") & F.col("occurred_at").isNull(), pair("codex_invalid_usage_timestamp")), F.when(event & ~F.col("_known"), pair("codex_usage_without_session_meta")),
        F.when(event & F.col("raw_model").isNull(), pair("codex_usage_without_model_context")), F.when(event & ~F.col("subsets"), pair("codex_invalid_input_subsets")), F.when(event & ~F.col("reasoning"), pair("codex_invalid_reasoning_subset")),
    ))
    told = by_line.unionByName(deltas.select("source_id", "line_number", F.explode(found).alias("w")))
    told = told.select("source_id", "line_number", "w.code", F.coalesce("w.key", F.lit("")).alias("key"))
    of_meta = lambda df, code: df.select("source_id", "line_number", F.lit(code).alias("code"), F.lit("").alias("key"))
    told = told.unionByName(of_meta(early, "codex_primary_session_meta_missing")).unionByName(of_meta(bare, "codex_missing_client_version"))
    each, once = told.where(~F.col("code").isin(*ONCE)), told.where(F.col("code").isin(*ONCE))
    return each.drop("key").unionByName(once_per_key(once, ["source_id", "code", "key"]).select("source_id", "line_number", "code"))


def _roots(root: str) -> list[str]:
    return [f"{root}/sessions", f"{root}/archived_sessions"]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The log files below root/sessions and root/archived_sessions, none of them opened."""
    return prefer_plain(listed_files(spark, _roots(root), PATTERN))


def read(spark: SparkSession, root: str, files: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, observations and warnings below root/sessions and root/archived_sessions, or of some of the files listed there."""
    files, lines, tails = file_lines(listed(spark, root) if files is None else files)
    seen, warnings = observations(lines, profiles)
    return files, seen, warnings.unionByName(tails)


__all__ = ["CLIENT", "COUNTERS", "FLAGS", "NOTES", "ONCE", "judged", "listed", "observations", "observed", "read", "records"]
