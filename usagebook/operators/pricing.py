"""List prices of events, as intervals.

The catalog is small, so it is folded to one row a (provider, raw model) with
its aliases and one row a (provider, canonical model) with its rates, modifiers
and overrides. An event meets both by equi-joins, which never multiply its rows;
all else (effective dates, token ranges, dimensions, scenarios, modifiers,
component costs) are expressions over those arrays in the event's own row, so
pricing needs no shuffle.

Unknown is never zero: what can't be priced is listed as missing and the amount
is a lower bound, or null where nothing is known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from usagebook.functions.tables import written
from usagebook.functions.values import BROADCAST_ROWS, UNRESOLVED, contains, is_api_key, resolved, small

KINDS = ("usd", "credits")
DIMENSIONS = ("auth_mode", "provider_route", "service_tier", "speed", "inference_geo")
#: Scenarios of an event beyond which it counts as unpriced.
MAX_SCENARIOS = 1024
#: Scenarios of a cell up to which their amounts are written out as columns, in generated code and whole numbers.
WRITTEN_OUT = 8
#: Bytes of a generated method beyond which HotSpot leaves it interpreted; Spark then generates smaller ones, an operator at a time.
COMPILED = 8000
#: Amounts are whole numbers of 10 ** -15.
_ONE = 10**15
TOKENS = (
    ("input_uncached", "input_tokens_uncached", "input"), ("cache_read", "input_tokens_cached", "cache_read"),
    ("cache_write_unknown", "cache_write_unknown_tokens", "cache_write"), ("cache_write_5m", "cache_write_5m_tokens", "cache_write_5m"),
    ("cache_write_1h", "cache_write_1h_tokens", "cache_write_1h"), ("output", "output_tokens_total", "output"),
)
TOOLS = (("web_search_requests", "web_search"), ("web_fetch_requests", "web_fetch"))


@dataclass
class Catalog:
    """aliases, rates, modifiers as in the catalog document, exploded to tables.

    policies: rate_id, dimension, allowed array, default_value, value_aliases map.
    modifiers: selectors map<string, string>. overrides may be None.
    """

    aliases: DataFrame
    rates: DataFrame
    policies: DataFrame
    modifiers: DataFrame
    overrides: DataFrame | None = None


def _during(x: str) -> str:
    return f"{x}.effective_from <= _time.low and ({x}.effective_to is null or _time.low < {x}.effective_to)"


def _spans(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each span of time (_time.low, _time.high) in which the same elements of the arrays are in effect, and these elements only."""
    ends = ", ".join(f"transform({c}, r -> r.effective_{e})" for c in arrays for e in ("from", "to"))
    cut = df.withColumn("_time", F.expr(f"array_sort(array_distinct(array_compact(concat({ends}))))")).withColumn("_time", F.expr("explode(transform(_time, (x, i) -> struct(x as low, get(_time, i + 1) as high)))"))
    return cut.withColumns({c: F.expr(f"filter({c}, r -> {_during('r')})") for c in arrays})


def _within(span: Column, value: Column) -> Column:
    return (span["low"] <= value) & (span["high"].isNull() | (value < span["high"]))


def resolve_models(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds canonical_model and alias_id: the one alias in effect, null if there is none or more than one."""
    grouped = aliases.groupBy(F.lower(F.trim("provider")).alias("_provider"), F.col("raw_model").alias("_raw")).agg(F.collect_list(F.struct("id", "canonical_model", "effective_from", "effective_to")).alias("_aliases"))
    one = _spans(grouped, "_aliases").where("size(_aliases) = 1").select("_provider", "_raw", F.col("_time").alias("_span"), F.col("_aliases")[0].alias("_alias"))
    joined = events.join(small(one), (F.lower(F.trim(events["provider"])) == F.col("_provider")) & (events["raw_model"] == F.col("_raw")) & _within(F.col("_span"), events["occurred_at"]), "left")
    return joined.withColumns({"canonical_model": F.col("_alias.canonical_model"), "alias_id": F.col("_alias.id")}).drop("_provider", "_raw", "_span", "_alias")


def entries(catalog: Catalog) -> DataFrame:
    """One row a (provider, canonical model): its rates with their policies, its modifiers and its overrides."""
    policy = catalog.policies.groupBy("rate_id").agg(F.array_sort(F.collect_list(F.struct("dimension", F.array_distinct("allowed").alias("allowed"), "default_value", "value_aliases")), lambda a, b: F.when(a["dimension"] < b["dimension"], -1).when(a["dimension"] > b["dimension"], 1).otherwise(0)).alias("policies"))
    names = ["id", "kind", "unit_scale", "effective_from", "effective_to", "min_input_tokens", "max_input_tokens_exclusive", *[r for _, _, r in TOKENS], "web_search", "web_fetch", "tool_per_units", "cache_write_observation_required"]
    rates = catalog.rates.join(policy, catalog.rates["id"] == policy["rate_id"], "left").withColumn("policies", F.coalesce("policies", F.array().cast(policy.schema["policies"].dataType)))
    out = rates.groupBy(F.lower(F.trim("provider")).alias("_provider"), F.col("canonical_model").alias("_model")).agg(F.collect_list(F.struct(*names, "policies")).alias("_rates"))
    mods = catalog.modifiers.groupBy(F.lower(F.trim("provider")).alias("_provider"), F.col("canonical_model").alias("_model")).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "effective_from", "effective_to", "scope", "multiplier", F.array_sort(F.map_entries("selectors")).alias("selectors")))).alias("_modifiers"))
    out = out.join(mods, ["_provider", "_model"], "full_outer")
    if catalog.overrides is not None:
        return out.join(_overrides(catalog.overrides), ["_provider", "_model"], "full_outer")
    return out.withColumn("_overrides", F.expr("cast(null as array<struct<id: string, dimension: string, value: string, effective_from: timestamp, effective_to: timestamp>>)"))


def _overrides(overrides: DataFrame) -> DataFrame:
    """One row a (provider, canonical model): its overrides."""
    return overrides.groupBy(F.lower(F.trim("provider")).alias("_provider"), F.col("canonical_model").alias("_model")).agg(F.collect_list(F.struct("id", F.lower(F.trim("dimension")).alias("dimension"), F.lower(F.trim("value")).alias("value"), "effective_from", "effective_to")).alias("_overrides"))


def observed_dimensions() -> Column:
    """What the event says of its routing, in lower case; a fast service tier also says the speed."""
    value = lambda c: F.lower(F.trim(F.col(c)))
    pairs = [F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in ("auth_mode", "provider_route", "service_tier", "inference_geo")]
    speed = F.struct(F.lit("speed").alias("key"), F.coalesce(value("speed"), F.when(value("service_tier") == "fast", "fast")).alias("value"))
    return F.map_from_entries(F.filter(F.array(*pairs, speed), lambda e: e["value"].isNotNull()))


_UNRESOLVED = ", ".join(f"'{v}'" for v in UNRESOLVED)
#: A policy's value for x: its alias if it has one, null unless allowed.
_ALLOWED = "filter(array(coalesce(try_element_at(p.value_aliases, {x}), {x})), v -> array_contains(p.allowed, v) and lower(trim({x})) not in (" + _UNRESOLVED + "))"


def _scenarios(kind: str) -> str:
    """Arrays of dimension maps: every combination of the values that each policy leaves open; empty if a stated value isn't allowed."""
    stated = "coalesce(try_element_at(_override, p.dimension), case when lower(try_element_at(_dims_{k}, p.dimension)) not in ({u}) then try_element_at(_dims_{k}, p.dimension) end)".format(k=kind, u=_UNRESOLVED)
    choices = f"if({stated} is null, p.allowed, {_ALLOWED.format(x=stated)})"
    return f"aggregate(_rate_{kind}.policies, array(cast(map() as map<string, string>)), (acc, p) -> if(cast(size(acc) as bigint) * size({choices}) > {MAX_SCENARIOS}, cast(array() as array<map<string, string>>), flatten(transform(acc, m -> transform({choices}, c -> map_concat(m, map(p.dimension, c)))))))"


def _default(kind: str) -> str:
    """The one map in which missing dimensions have the catalog's default; empty if one has none or isn't allowed."""
    stated = f"coalesce(try_element_at(_override, p.dimension), try_element_at(_dims, p.dimension), p.default_value, '')"
    return f"aggregate(_rate_{kind}.policies, array(cast(map() as map<string, string>)), (acc, p) -> flatten(transform(acc, m -> transform({_ALLOWED.format(x=stated)}, c -> map_concat(m, map(p.dimension, c))))))"


def _estimates(kind: str, scenarios: str) -> str:
    """For each scenario its status, exact, known and upper amount, modifiers and missing components."""
    rate, usd = f"_rate_{kind}", kind == "usd"
    fits = f"filter(_modifiers_{kind}, m -> forall(m.selectors, s -> try_element_at(d, s.key) <=> s.value))"
    product = lambda scope: f"aggregate(filter({fits}, m -> m.scope in ('{scope}', 'all')), cast(1 as decimal(18,9)), (x, m) -> try_cast(x * m.multiplier as decimal(18,9)))"
    zero = "cast(0 as bigint)"
    quantity = {c: c for _, c, _ in TOKENS}
    if not usd:  # credits know input, cached input and output only
        quantity |= {"input_tokens_uncached": "greatest(input_tokens_total - input_tokens_cached, 0)"} | {c: zero for c in quantity if c.startswith("cache_write")}
    parts = [f"struct('{n}' as component, {quantity[c]} as quantity, {rate}.{r} as rate, {rate}.unit_scale as per, false as tool)" for n, c, r in TOKENS]
    parts += [f"struct('{c}' as component, {c} as quantity, {rate}.{r} as rate, {rate}.tool_per_units as per, true as tool)" for c, r in TOOLS]
    cost = "try_cast(cast(c.quantity as decimal(19,0)) * try_cast(c.rate * if(c.tool, d.tools, d.tokens) / c.per as decimal(18,15)) as decimal(38,15))"
    unit = lambda r: f"try_cast(cast(input_tokens_uncached as decimal(19,0)) * try_cast({rate}.{r} * e.tokens / {rate}.unit_scale as decimal(18,15)) as decimal(38,15))"
    staged = f"transform({scenarios}, d -> struct(d as dimensions, {product('token_rates')} as tokens, {product('tool_rates')} as tools, transform({fits}, m -> m.id) as modifier_ids))"
    costed = f"transform({staged}, d -> struct(d.dimensions, d.tokens, d.modifier_ids, transform(filter(array({', '.join(parts)}), c -> c.quantity > 0), c -> struct(c.component, c.quantity, c.rate, {cost} as cost)) as parts))"
    observation = f"if({rate}.cache_write_observation_required and not coalesce(cache_write_data_complete, false), array(struct('cache_write_observation' as component, cast(null as bigint) as quantity)), array())" if usd else "array()"
    gap = "array<struct<component: string, quantity: bigint>>"
    summed = f"transform({costed}, d -> struct(d.dimensions, d.tokens, d.modifier_ids, exists(d.parts, c -> c.rate is not null and c.cost is null) as overflow, aggregate(filter(d.parts, c -> c.rate is not null), cast(0 as decimal(38,15)), (x, c) -> try_cast(x + c.cost as decimal(38,15))) as subtotal, size(filter(d.parts, c -> c.rate is not null)) as priced, concat(cast(transform(filter(d.parts, c -> c.rate is null), c -> struct(c.component, c.quantity)) as {gap}), cast({observation} as {gap})) as missing))"
    reclassify = f"lower(trim(provider)) = 'openai' and coalesce(input_subset_accounting_consistent, true) and size(e.missing) = 1 and e.missing[0].component = 'cache_write_observation' and {rate}.input is not null and {rate}.cache_write is not null" if usd else "false"
    low, high = (f"e.subtotal - {unit('input')} + {f}({unit('input')}, {unit('cache_write')})" for f in ("least", "greatest"))
    amount = lambda x: f"try_cast({x} as decimal(38,15))"
    return (
        f"transform({summed}, e -> struct(e.dimensions, e.modifier_ids, e.missing,"
        f" case when e.overflow or e.subtotal is null then 'unpriced' when size(e.missing) = 0 then 'priced' else 'partial' end as status,"
        f" case when not e.overflow and size(e.missing) = 0 then e.subtotal end as exact,"
        f" case when e.overflow then null when size(e.missing) = 0 then e.subtotal when {reclassify} then {amount(low)} when e.priced > 0 and e.subtotal <> 0 then e.subtotal end as known,"
        f" case when e.overflow then null when size(e.missing) = 0 then e.subtotal when {reclassify} then {amount(high)} end as upper))"
    )


def _range(kind: str) -> dict[str, Column]:
    """Status and bounds over an event's scenarios."""
    s = f"_scenarios_{kind}"
    none = f"coalesce(size({s}), 0) = 0"
    return {
        f"{kind}_status": F.expr(f"case when {none} or forall({s}, e -> e.status = 'unpriced') then 'unpriced' when forall({s}, e -> e.known is not null and e.upper is not null) then if(array_min(transform({s}, e -> e.known)) = array_max(transform({s}, e -> e.upper)), 'exact', 'bounded') else 'partial' end"),
        f"{kind}_lower": F.expr(f"case when {none} or forall({s}, e -> e.status = 'unpriced') then null when forall({s}, e -> e.known is not null) then array_min(transform({s}, e -> e.known)) end"),
        f"{kind}_upper": F.expr(f"case when {none} or forall({s}, e -> e.status = 'unpriced') then null when forall({s}, e -> e.known is not null and e.upper is not null) then array_max(transform({s}, e -> e.upper)) end"),
    }


def with_rates(events: DataFrame, catalog: Catalog) -> DataFrame:
    """Events with their model, and for each kind the one rate in effect and its modifiers in effect."""
    for name in ("provider_route", "speed"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    out = resolve_models(events, catalog.aliases)
    out = out.join(small(entries(catalog)), (F.lower(F.trim(out["provider"])) == F.col("_provider")) & (out["canonical_model"] == F.col("_model")), "left")
    now = F.col("occurred_at")
    out = out.withColumns({"_total": _tokens(), "_dims": observed_dimensions()})
    active = F.filter("_overrides", lambda o: contains(o["effective_from"], o["effective_to"], now))
    out = out.withColumn("_override", F.coalesce(F.map_from_entries(F.transform(active, lambda o: F.struct(o["dimension"].alias("key"), o["value"].alias("value")))), F.expr("cast(map() as map<string, string>)")))
    for kind in KINDS:
        found = F.filter("_rates", lambda r: (r["kind"] == kind) & contains(r["effective_from"], r["effective_to"], now) & (F.col("_total") >= F.coalesce(r["min_input_tokens"], F.lit(0))) & (r["max_input_tokens_exclusive"].isNull() | (F.col("_total") < r["max_input_tokens_exclusive"])))  # noqa: B023
        out = out.withColumn(f"_found_{kind}", found).withColumns(
            {
                f"{kind}_matches": F.coalesce(F.size(f"_found_{kind}"), F.lit(0)),
                f"_rate_{kind}": F.when(F.size(f"_found_{kind}") == 1, F.col(f"_found_{kind}")[0]),
                f"_modifiers_{kind}": F.coalesce(F.filter("_modifiers", lambda m: (m["kind"] == kind) & contains(m["effective_from"], m["effective_to"], now)), F.expr("cast(array() as array<struct<id: string, kind: string, effective_from: timestamp, effective_to: timestamp, scope: string, multiplier: decimal(9,4), selectors: array<struct<key: string, value: string>>>>)")),  # noqa: B023
            }
        )
    return out


def cells(catalog: Catalog) -> DataFrame:
    """The catalog cut where anything changes: one row a (provider, model, kind), span of time and span of tokens.

    Within a cell the rates and modifiers in effect are the same, so each event
    meets one cell at most, and its rate's scenarios have fixed unit prices.
    """
    none = "cast(array() as array<struct<id: string, kind: string, effective_from: timestamp, effective_to: timestamp, scope: string, multiplier: decimal(9,4), selectors: array<struct<key: string, value: string>>>>)"
    base = entries(catalog).select("_provider", "_model", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("_kind"), "_rates", F.expr(f"coalesce(_modifiers, {none})").alias("_modifiers"))
    base = base.withColumns({c: F.expr(f"filter({c}, r -> r.kind = _kind and r.effective_from is not null)") for c in ("_rates", "_modifiers")}).where("size(_rates) > 0")
    sizes = "array_sort(array_distinct(array_compact(concat(transform(_rates, r -> coalesce(r.min_input_tokens, 0L)), transform(_rates, r -> r.max_input_tokens_exclusive)))))"
    cut = _spans(base.withColumn("_size", F.expr(sizes)), "_rates", "_modifiers").withColumn("_size", F.expr("explode(transform(_size, (x, i) -> struct(x as low, get(_size, i + 1) as high)))"))
    cut = cut.withColumn("_found", F.expr("filter(_rates, r -> coalesce(r.min_input_tokens, 0L) <= _size.low and (r.max_input_tokens_exclusive is null or _size.low < r.max_input_tokens_exclusive))")).where("size(_found) > 0")
    return cut.select("_provider", "_model", "_kind", "_time", "_size", F.size("_found").alias("_matches"), F.expr("if(size(_found) = 1, _found[0], null)").alias("_rate"), "_modifiers").withColumn(
        "_combinations", F.expr("aggregate(_rate.policies, 1D, (x, p) -> x * size(p.allowed))")
    )


def _with_units(cut: DataFrame, dimensions: list[str], dims: bool = False) -> DataFrame:
    """Cells with what each dimension may be stated as, and all scenarios of their rate: value of each dimension (as a map too, if dims), modifiers, and a unit price for each component, null where it has none or is out of range.

    n_ are the same prices as whole numbers, 0 where there is none. Quantities up to
    _room can't overflow sums of products with them; it is null for cells whose
    scenarios are too many to be written out, or have a price out of range.
    """
    choices = "aggregate(_rate.policies, array(cast(array() as array<string>)), (acc, p) -> flatten(transform(acc, m -> transform(p.allowed, c -> array_append(m, c)))))"
    mapped = f"transform({choices}, c -> map_from_arrays(transform(_rate.policies, p -> p.dimension), c))"
    fitting = f"transform({mapped}, d -> struct(d as dims, filter(_modifiers, m -> forall(m.selectors, s -> try_element_at(d, s.key) <=> s.value)) as mods))"
    product = "aggregate(filter(e.mods, m -> m.scope in ('{s}', 'all')), cast(1 as decimal(18,9)), (x, m) -> try_cast(x * m.multiplier as decimal(18,9)))"
    scaled = f"transform({fitting}, e -> struct(e.dims, transform(e.mods, m -> m.id) as modifier_ids, {product.format(s='token_rates')} as tokens, {product.format(s='tool_rates')} as tools))"
    unit = "try_cast(_rate.{r} * d.{by} / nullif(_rate.{per}, 0L) as decimal(18,15)) as u_{r}"
    units = [unit.format(r=r, by="tokens", per="unit_scale") for _, _, r in TOKENS] + [unit.format(r=r, by="tools", per="tool_per_units") for _, r in TOOLS]
    values = [f"try_element_at(d.dims, {_quoted(d)}) as c_{i}" for i, d in enumerate(dimensions)]
    cut = cut.withColumn("_all", F.expr(f"transform({scaled}, d -> struct({', '.join(['d.modifier_ids', *(['d.dims'] if dims else []), *values, *units])}))"))
    rates = [r for _, _, r in TOKENS] + [r for _, r in TOOLS]
    whole = [f"coalesce(cast(s.u_{r} * cast({_ONE} as decimal(16,0)) as bigint), 0L) as n_{r}" for r in rates]
    cut = cut.withColumn("_all", F.expr(f"transform(_all, s -> struct({', '.join([f's.{f.name}' for f in cut.schema['_all'].dataType.elementType.fields] + whole)}))"))
    sound = " and ".join(f"(_rate.{r} is null or s.u_{r} is not null)" for r in rates)
    most = f"array_max(transform(_all, s -> {' + '.join(f'abs(s.n_{r})' for r in rates)}))"
    cut = cut.withColumn("_room", F.expr(f"if(size(_all) between 1 and {WRITTEN_OUT} and forall(_all, s -> {sound}), 4000000000000000000L div greatest({most}, 1L), null)"))
    aliased = "coalesce(p.value_aliases, cast(map() as map<string, string>))"
    said = f"map_from_entries(concat(transform(filter(p.allowed, a -> not map_contains_key({aliased}, a) and lower(trim(a)) not in ({_UNRESOLVED})), a -> struct(a as key, a as value)), filter(map_entries({aliased}), e -> array_contains(p.allowed, e.value) and lower(trim(e.key)) not in ({_UNRESOLVED}))))"
    for i, d in enumerate(dimensions):
        cut = cut.withColumn(f"_p{i}", F.expr(f"get(transform(filter(_rate.policies, p -> p.dimension = {_quoted(d)}), p -> struct(p.default_value as usual, {said} as said)), 0)"))
    return cut.drop("_modifiers", "_combinations")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stated(kind: str, dimensions: list[str], certain: bool = True) -> dict[str, Column]:
    """For each dimension whether it's open, the value stated, and the value with the catalog's default; null if not allowed. With certain, credits don't go by an uncertain way of authentication."""
    out = {}
    for i, d in enumerate(dimensions):
        own, any_ = F.try_element_at("_override", F.lit(d)), F.col(f"_d_{d}") if d in DIMENSIONS else F.lit(None).cast("string")
        seen = F.when(~F.col("_uncertain"), any_) if certain and kind == "credits" and d == "auth_mode" else any_
        stated = F.coalesce(own, F.when(~seen.isin(*UNRESOLVED), seen))
        policy = F.col(f"_p{i}_{kind}")
        out[f"_open{i}_{kind}"] = policy.isNull() | stated.isNull()
        out[f"_value{i}_{kind}"] = F.try_element_at(policy["said"], stated)
        out[f"_usual{i}_{kind}"] = F.try_element_at(policy["said"], F.coalesce(own, any_, policy["usual"], F.lit("")))
    return out


def _quantities(kind: str) -> dict[str, str]:
    """The quantity that each rate prices; credits know input, cached input and output only."""
    quantity = {r: c for _, c, r in TOKENS} | {r: c for c, r in TOOLS}
    if kind == "credits":
        quantity |= {"input": "greatest(input_tokens_total - input_tokens_cached, 0L)"} | {r: "0L" for r in quantity if r.startswith("cache_write")}
    return quantity


def _gaps(kind: str) -> dict[str, Column]:
    """What the amounts of a kind lack, the same in all scenarios; all in generated code."""
    rate, usd = f"_rate_{kind}", kind == "usd"
    quantity = _quantities(kind)
    unseen = f"coalesce({rate}.cache_write_observation_required and not coalesce(cache_write_data_complete, false), false)" if usd else "false"
    lacking = " + ".join(f"if(coalesce({q} > 0, false) and {rate}.{r} is null, 1, 0)" for r, q in quantity.items())
    count = f"{lacking} + if({unseen}, 1, 0)"
    shifts = f"coalesce(lower(trim(provider)) = 'openai' and coalesce(input_subset_accounting_consistent, true) and {unseen} and ({count}) = 1 and {rate}.input is not null and {rate}.cache_write is not null, false)" if usd else "false"
    priced = " or ".join(f"(coalesce({q} > 0, false) and {rate}.{r} is not null)" for r, q in quantity.items())
    return {f"_gaps_{kind}": F.expr(count), f"_unseen_{kind}": F.expr(unseen), f"_shifts_{kind}": F.expr(shifts), f"_some_{kind}": F.expr(priced)}


def _fits(kind: str, dimensions: list[str], s: str) -> str:
    """Whether a scenario is one that an event leaves open."""
    return " and ".join(["true", *[f"(_open{i}_{kind} or (_value{i}_{kind} is not null and _value{i}_{kind} <=> {s}.c_{i}))" for i in range(len(dimensions))]])


def _usual(kind: str, dimensions: list[str], s: str) -> str:
    """Whether it is the one of the catalog's defaults."""
    return " and ".join(["true", *[f"(_p{i}_{kind} is null or (_usual{i}_{kind} is not null and _usual{i}_{kind} <=> {s}.c_{i}))" for i in range(len(dimensions))]])


def _subtotal(kind: str, s: str) -> str:
    """The sum of an event's quantities times a scenario's unit prices; null if out of range."""
    total = "cast(0 as decimal(38,15))"
    for r, q in _quantities(kind).items():
        if q != "0L":
            total = f"try_cast({total} + if(coalesce({q} > 0, false) and _rate_{kind}.{r} is not null, {_cost(q, f'{s}.u_{r}')}, cast(0 as decimal(38,15))) as decimal(38,15))"
    return total


def _cost(quantity: str, price: str) -> str:
    return f"try_cast(cast({quantity} as decimal(19,0)) * {price} as decimal(38,15))"


def _known(kind: str, amount: str, read: str, written: str, shifted: str = "try_cast({x} as decimal(38,15))") -> tuple[str, str]:
    """What of a scenario's amount is known at least and at most; where only the observation of cache writes lacks, uncached input may be either."""
    shift = lambda f: shifted.format(x=f"{amount} - {read} + {f}({read}, {written})")
    whole = f"_gaps_{kind} = 0"
    return (
        f"case when {whole} then {amount} when _shifts_{kind} then {shift('least')} when _some_{kind} and {amount} <> 0 then {amount} end",
        f"case when {whole} then {amount} when _shifts_{kind} then {shift('greatest')} end",
    )


def _walked(kind: str, dimensions: list[str]) -> Column:
    """Counts and bounds over the scenarios that an event leaves open, for events whose amounts aren't written out."""
    shift = lambda r: f"if(_shifts_{kind}, {_cost('input_tokens_uncached', f's.u_{r}')}, null)"
    summed = f"transform(filter(_all_{kind}, s -> {_fits(kind, dimensions, 's')}), s -> struct(s.modifier_ids, {_usual(kind, dimensions, 's')} as usual, {_subtotal(kind, 's')} as subtotal, {shift('input')} as read, {shift('cache_write')} as written))"
    known, upper = _known(kind, "e.subtotal", "e.read", "e.written")
    bounds = f"transform({summed}, e -> struct(e.modifier_ids, e.usual, e.subtotal is null as bad, {known} as known, {upper} as upper))"
    start = "named_struct('n', 0, 'bad', 0, 'known', 0, 'both', 0, 'low', cast(null as decimal(38,15)), 'high', cast(null as decimal(38,15)), 'usual_bad', cast(null as boolean), 'ids', cast(array() as array<string>))"
    step = "named_struct('n', a.n + 1, 'bad', a.bad + if(e.bad, 1, 0), 'known', a.known + if(e.known is null, 0, 1), 'both', a.both + if(e.known is null or e.upper is null, 0, 1), 'low', least(a.low, e.known), 'high', greatest(a.high, e.upper), 'usual_bad', coalesce(a.usual_bad, if(e.usual, e.bad, null)), 'ids', if(size(e.modifier_ids) = 0, a.ids, concat(a.ids, e.modifier_ids)))"
    return F.expr(f"if(_rate_{kind} is null or _plain_{kind}, null, aggregate({bounds}, {start}, (a, e) -> {step}))")


def _plain(kind: str) -> Column:
    """Whether an event's amounts can be taken in whole numbers, scenario by scenario."""
    used = [q for q in _quantities(kind).values() if q != "0L"]
    return F.expr(f"coalesce(greatest({', '.join([*used, 'input_tokens_uncached'])}) <= _room_{kind} and coalesce(input_tokens_uncached, 0L) >= 0, false)")


def _whole(kind: str, s: str) -> str:
    """An event's quantities times a scenario's unit prices, in whole numbers."""
    return " + ".join(f"greatest(coalesce({q}, 0L), 0L) * {s}.n_{r}" for r, q in _quantities(kind).items() if q != "0L")


def _amount(whole: str) -> str:
    return f"cast(cast({whole} as decimal(19,0)) * cast('0.000000000000001' as decimal(15,15)) as decimal(38,15))"


def _written_out(kind: str, dimensions: list[str], most: int) -> list[dict[str, Column]]:
    """Whether each scenario of a cell fits and what of its amount is known, by columns, in steps of which each uses the one before."""
    first, second = {}, {}
    for k in range(most):
        s, at = f"get(_all_{kind}, {k})", f"{k}_{kind}"
        first[f"_fit{at}"] = F.expr(f"_plain_{kind} and {s} is not null and {_fits(kind, dimensions, s)}")
        first[f"_sum{at}"] = F.expr(f"if(_plain_{kind} and {s} is not null and {_fits(kind, dimensions, s)}, {_whole(kind, s)}, null)")
        known, upper = _known(kind, f"_sum{at}", f"(input_tokens_uncached * {s}.n_input)", f"(input_tokens_uncached * {s}.n_cache_write)", "{x}")
        second[f"_known{at}"], second[f"_upper{at}"] = (F.expr(f"if(_fit{at}, {x}, null)") for x in (known, upper))
    return [first, second]


def _counts(kind: str, dimensions: list[str], most: int) -> dict[str, Column]:
    """Counts and bounds over the scenarios of an event, written out or walked over."""
    g, ks = f"_walked_{kind}", range(most)
    either = lambda plain, own: F.expr(f"if(_plain_{kind}, {plain}, {g}.{own})")
    count = lambda c: " + ".join(f"if({c.format(k=k, kind=kind)}, 1, 0)" for k in ks)
    amount = lambda f, c: _amount(f"{f}({', '.join([f'{c}{k}_{kind}' for k in ks] + ['cast(null as bigint)'] * 2)})")
    usual = " or ".join(f"(_fit{k}_{kind} and {_usual(kind, dimensions, f'get(_all_{kind}, {k})')})" for k in ks)
    ids = ", ".join(f"if(_fit{k}_{kind}, get(_all_{kind}, {k}).modifier_ids, cast(array() as array<string>))" for k in ks)
    return {
        f"_n_{kind}": either(count("_fit{k}_{kind}"), "n"), f"_bad_{kind}": either("0", "bad"), f"_knowns_{kind}": either(count("_known{k}_{kind} is not null"), "known"), f"_boths_{kind}": either(count("_upper{k}_{kind} is not null"), "both"),
        f"_low_{kind}": either(amount("least", "_known"), "low"), f"_high_{kind}": either(amount("greatest", "_upper"), "high"), f"_usual_bad_{kind}": either(f"if({usual}, false, null)", "usual_bad"), f"_ids_{kind}": either(f"concat({ids})", "ids"),
    }


def _bounds(kind: str) -> dict[str, Column]:
    """Status, bounds and status by the catalog's defaults, from the counts over scenarios."""
    n = f"_n_{kind}"
    none = f"coalesce({n}, 0) = 0 or _bad_{kind} = {n}"
    return {
        f"{kind}_status": F.expr(f"case when {none} then 'unpriced' when _boths_{kind} = {n} then if(_low_{kind} = _high_{kind}, 'exact', 'bounded') else 'partial' end"),
        f"{kind}_lower": F.expr(f"case when {none} then null when _knowns_{kind} = {n} then _low_{kind} end"),
        f"{kind}_upper": F.expr(f"case when {none} then null when _boths_{kind} = {n} then _high_{kind} end"),
        f"_legacy_{kind}": F.expr(f"case when coalesce(_usual_bad_{kind}, true) then 'unpriced' when _gaps_{kind} = 0 then 'priced' else 'partial' end"),
    }


def _tokens() -> Column:
    """What token ranges of rates are about: the reported total of input tokens, or the sum of the classes."""
    writes = [F.col(f"cache_write_{k}_tokens") for k in ("unknown", "5m", "1h")]
    return F.when(F.col("input_tokens_total") > 0, F.col("input_tokens_total")).otherwise(F.col("input_tokens_uncached") + F.col("input_tokens_cached") + writes[0] + writes[1] + writes[2])


def _authentication(out: DataFrame) -> DataFrame:
    """_uncertain: the way of authentication is missing or inferred; _api_key: it was an API key."""
    override = F.try_element_at("_override", F.lit("auth_mode"))
    uncertain = override.isNull() & (F.col("auth_mode").isNull() | F.coalesce(F.col("auth_mode_provenance") == "current_profile_inferred", F.lit(False)))
    return out.withColumns({"_uncertain": uncertain, "_api_key": ~uncertain & is_api_key(F.coalesce(override, F.col("auth_mode")))})


def _with_cells(events: DataFrame, catalog: Catalog, cut: DataFrame, few: bool, dimensions: list[str], kinds: tuple[str, ...] = KINDS, certain: bool = True, rows: bool = False) -> DataFrame:
    """Events with the cells that they meet, by one equi-join a kind, whose spans are tested in the join, and what they leave open or lack.

    With rows, an event meets each scenario of its cell (_s_) by itself, and these are made once, before events meet them.
    """
    out = resolve_models(events, catalog.aliases)
    provider = F.lower(F.trim(events["provider"]))
    attested = F.lit(None).cast("map<string, string>")
    if catalog.overrides is not None:
        own = _overrides(catalog.overrides).select(F.col("_provider").alias("_po"), F.col("_model").alias("_mo"), F.array_sort("_overrides").alias("_overrides"))
        own = _spans(own, "_overrides").where("size(_overrides) > 0").withColumnRenamed("_time", "_to")
        first = "map_from_entries(transform(filter(_overrides, (o, i) -> not exists(slice(_overrides, 1, i), x -> x.dimension = o.dimension)), o -> struct(o.dimension as key, o.value as value)))"
        own = own.withColumn("_attested", F.expr(first)).drop("_overrides")
        out = out.join(small(own), (provider == F.col("_po")) & (F.col("canonical_model") == F.col("_mo")) & _within(F.col("_to"), F.col("occurred_at")), "left")
        attested = F.col("_attested")
    said = {f"_d_{d}": F.lower(F.trim(d)) for d in DIMENSIONS}
    said["_d_speed"] = F.coalesce(said["_d_speed"], F.when(said["_d_service_tier"] == "fast", "fast"))
    out = _authentication(out.withColumns({"_override": attested, "_total": _tokens(), **said}))
    units = _with_units(cut, dimensions, rows)
    if rows:
        units = written(units.withColumn("_s", F.explode("_all")).drop("_all"), "scenarios")
    for kind in kinds:
        side = units.where(F.col("_kind") == kind).drop("_kind")
        side = side.withColumnsRenamed({c: f"{c}_{kind}" for c in side.columns})
        inside = _within(F.col(f"_time_{kind}"), F.col("occurred_at")) & _within(F.col(f"_size_{kind}"), F.col("_total"))
        out = out.join(F.broadcast(side) if few else side, (provider == F.col(f"_provider_{kind}")) & (F.col("canonical_model") == F.col(f"_model_{kind}")) & inside, "left")
        out = out.withColumns({f"{kind}_matches": F.coalesce(f"_matches_{kind}", F.lit(0)), **_stated(kind, dimensions, certain), **_gaps(kind)})
    return out


def _dimensions(catalog: Catalog) -> list[str]:
    return sorted(r[0] for r in catalog.policies.select("dimension").distinct().collect())  # names of dimensions, not rows of data


def _missing(kind: str) -> str:
    """The components that an event lacks a price for."""
    names = {r: n for n, _, r in TOKENS} | {r: c for c, r in TOOLS}
    gaps = [f"if(coalesce({q} > 0, false) and _rate_{kind}.{r} is null, struct('{names[r]}' as component, {q} as quantity), null)" for r, q in _quantities(kind).items() if q != "0L"]
    gaps.append(f"if(_unseen_{kind}, struct('cache_write_observation' as component, cast(null as bigint) as quantity), null)")
    return f"array_compact(array({', '.join(gaps)}))"


def _by_cells(events: DataFrame, catalog: Catalog, cut: DataFrame, few: bool, most: int) -> DataFrame:
    """Events with status and bounds of both kinds, from the cells that they meet.

    Scenarios of cells that have few are written out as columns, in whole numbers
    and generated code; others, and amounts beyond whole numbers, are walked over.
    """
    dimensions = _dimensions(catalog)
    most = max(1, min(most, WRITTEN_OUT))
    out = _with_cells(events, catalog, cut, few, dimensions).withColumns({f"_plain_{k}": _plain(k) for k in KINDS})
    out = out.withColumns({f"_walked_{k}": _walked(k, dimensions) for k in KINDS})
    for usd, credits in zip(*[_written_out(k, dimensions, most) for k in KINDS], strict=True):
        out = out.withColumns(usd | credits)
    out = out.withColumns({**_counts("usd", dimensions, most), **_counts("credits", dimensions, most)})
    none = "cast(array() as array<struct<component: string, quantity: bigint>>)"
    return out.withColumns(
        {
            **_bounds("usd"), **_bounds("credits"),
            "missing": F.expr(f"if(_usual_bad_usd is null or _gaps_usd = 0, {none}, array_sort({_missing('usd')}))"),
            "matched_ids": F.expr("sort_array(array_except(concat(array(_rate_usd.id, _rate_credits.id), coalesce(_ids_usd, array())), array(cast(null as string))))"),
            "scenario_count": F.coalesce("_n_usd", F.lit(0)),
        }
    )


def _by_expressions(events: DataFrame, catalog: Catalog) -> DataFrame:
    """The same for a catalog with a rate of too many combinations to be stored: scenarios are made from each event's own dimensions."""
    out = _authentication(with_rates(events, catalog))
    out = out.withColumns({"_dims_usd": F.col("_dims"), "_dims_credits": F.when(F.col("_uncertain"), F.map_filter("_dims", lambda k, _: k != "auth_mode")).otherwise(F.col("_dims"))})
    for kind in KINDS:
        rated = F.col(f"_rate_{kind}").isNotNull()
        out = out.withColumns({f"_scenarios_{kind}": F.when(rated, F.expr(_estimates(kind, _scenarios(kind)))), f"_default_{kind}": F.when(rated, F.get(F.expr(_default(kind)), F.lit(0)))})
        # the scenario of the default dimensions; none if they can't be resolved
        out = out.withColumn(f"_legacy_{kind}", F.expr(f"get(filter(_scenarios_{kind}, e -> _default_{kind} is not null and forall(map_entries(e.dimensions), x -> try_element_at(_default_{kind}, x.key) <=> x.value)), 0)"))
        out = out.withColumns(_range(kind))
    out = out.withColumns(
        {
            "missing": F.array_sort(F.coalesce("_legacy_usd.missing", F.expr("cast(array() as array<struct<component: string, quantity: bigint>>)"))),
            "matched_ids": F.expr("array_sort(array_distinct(concat(array_compact(array(_rate_usd.id, _rate_credits.id)), flatten(transform(coalesce(_scenarios_usd, array()), e -> e.modifier_ids)))))"),
            "scenario_count": F.coalesce(F.size("_scenarios_usd"), F.lit(0)),
        }
    )
    return out.withColumns({f"_legacy_{k}": F.coalesce(f"_legacy_{k}.status", F.lit("unpriced")) for k in KINDS})


def _held(cut: DataFrame) -> Row:
    """The most scenarios of one of a catalog's cells and those of all."""
    return cut.agg(F.max("_combinations").alias("most"), F.sum(F.greatest("_combinations", F.lit(1))).alias("all")).first()


def price(events: DataFrame, catalog: Catalog) -> DataFrame:
    """Events with canonical_model, alias_id, and for usd and credits status, lower and upper; legacy_status; matched_ids; missing.

    legacy_status takes the catalog's defaults for missing dimensions, whereas
    the bounds explore all allowed values; both are reported. Credits apply to
    client openai_codex unless it used an API key; where the way of
    authentication is missing or inferred their lower bound is 0.

    Unit prices are multiplied out once a cell of the catalog, not once an event.
    Cells are broadcast where all their scenarios together are at most
    BROADCAST_ROWS. A catalog in which a rate allows more than MAX_SCENARIOS
    combinations is priced from each event's own dimensions; results are the same.
    """
    for name in ("provider_route", "speed"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    events.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)  # for the session: the plan is compiled when it runs
    cut = cells(catalog)
    held = _held(cut)
    if (held["most"] or 0) <= MAX_SCENARIOS:
        out = _by_cells(events, catalog, cut, (held["all"] or 0) <= BROADCAST_ROWS, int(held["most"] or 0))
    else:
        out = _by_expressions(events, catalog)
    applies = (F.col("client") == "openai_codex") & ~F.col("_api_key")
    of = {k: F.col(f"_legacy_{k}") for k in KINDS}
    firm = F.col("credits_status").isin("exact", "bounded")
    legacy = F.when(applies & F.col("_uncertain"), "partial").when(~applies, of["usd"]).when(of["usd"] == of["credits"], of["usd"]).otherwise("partial")
    out = out.withColumns(
        {
            "legacy_status": legacy,
            "credits_lower": F.when(applies, F.when(F.col("_uncertain") & firm, F.lit(0).cast("decimal(38,15)")).otherwise(F.col("credits_lower"))),
            "credits_upper": F.when(applies, F.col("credits_upper")),
            "credits_status": F.when(~applies, "unavailable").when(F.col("_uncertain") & firm, "bounded").otherwise(F.col("credits_status")),
        }
    )
    return out.select(*events.columns, "canonical_model", "alias_id", "usd_matches", "credits_matches", "usd_status", "usd_lower", "usd_upper", "credits_status", "credits_lower", "credits_upper", "legacy_status", "missing", "matched_ids", "scenario_count")


def scenarios(events: DataFrame, catalog: Catalog, kind: str = "usd") -> DataFrame:
    """One row a scenario of an event: its dimensions, status and amounts.

    An event meets the scenarios of its cell by the join that price has, and amounts
    are columns of these rows: in whole numbers where they fit, else decimals. The
    cells and their scenarios are tables in the shared folder, as small as the catalog.
    """
    for name in ("provider_route", "speed"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    events.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)  # for the session: the plan is compiled when it runs
    cut = written(cells(catalog).where(F.col("_kind") == kind), "cells")
    held = _held(cut)
    if (held["most"] or 0) > MAX_SCENARIOS:
        return _scenarios_by_expressions(events, catalog, kind)
    dimensions = _dimensions(catalog)
    out = _with_cells(events, catalog, cut, (held["all"] or 0) <= BROADCAST_ROWS, dimensions, (kind,), certain=False, rows=True)
    out = out.withColumnRenamed(f"_s_{kind}", "_s").where(f"_s is not null and {_fits(kind, dimensions, '_s')}").withColumn("_plain", _plain(kind))
    out = out.withColumns({"_whole": F.expr(f"if(_plain, {_whole(kind, '_s')}, null)"), "_exact": F.expr(f"if(_plain, null, {_subtotal(kind, '_s')})")})
    whole = _known(kind, "_whole", "(input_tokens_uncached * _s.n_input)", "(input_tokens_uncached * _s.n_cache_write)", "{x}")
    exact = _known(kind, "_exact", *[f"if(_shifts_{kind}, {_cost('input_tokens_uncached', f'_s.u_{r}')}, null)" for r in ("input", "cache_write")])
    known, upper = (F.expr(f"if(_plain, {_amount(w)}, {e})") for w, e in zip(whole, exact, strict=True))
    return out.select(
        "client", "event_key", F.col("_s.dims").alias("dimensions"), F.col("_s.modifier_ids").alias("modifier_ids"), F.expr(_missing(kind)).alias("missing"),
        F.expr(f"case when _whole is null and _exact is null then 'unpriced' when _gaps_{kind} = 0 then 'priced' else 'partial' end").alias("status"),
        F.expr(f"case when _gaps_{kind} = 0 then if(_plain, {_amount('_whole')}, _exact) end").alias("exact"), known.alias("known"), upper.alias("upper"),
    )


def _scenarios_by_expressions(events: DataFrame, catalog: Catalog, kind: str) -> DataFrame:
    """The same for a catalog with a rate of too many combinations to be stored."""
    out = with_rates(events, catalog).withColumns({"_dims_usd": F.col("_dims"), "_dims_credits": F.col("_dims")}).where(F.col(f"_rate_{kind}").isNotNull())
    return out.select("client", "event_key", F.explode(F.expr(_estimates(kind, _scenarios(kind)))).alias("s")).select("client", "event_key", "s.*")


def unresolved_models(priced: DataFrame, limit: int = 20) -> DataFrame:
    """The first models without any pricing evidence."""
    return priced.where(F.size("matched_ids") == 0).select("client", "raw_model").distinct().orderBy("client", "raw_model").limit(limit)


__all__ = ["Catalog", "entries", "price", "resolve_models", "resolved", "scenarios", "unresolved_models", "with_rates"]
