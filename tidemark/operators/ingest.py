"""Usage, texts and identities from the response shapes of providers, and roots of run trees.

Defined results: an absent or unreadable response has no usage and no text; a value that is no number counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.json import strict_json
from tidemark.operators import ordered
from tidemark.operators.packing import PER_MESSAGE, PRIMING
from tidemark.storage import dropped, written

# Where each provider keeps its token counts, the first path that is set counting.
_CHAT_USAGE = {
    "input": ["$.usage.prompt_tokens", "$.usage.input_tokens"],
    "output": ["$.usage.completion_tokens", "$.usage.output_tokens"],
    "cached": ["$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens"],
    "reasoning": ["$.usage.completion_tokens_details.reasoning_tokens", "$.usage.output_tokens_details.reasoning_tokens"],
}
USAGE_PATHS = {
    "anthropic": {
        "input": ["$.usage.input_tokens"],
        "output": ["$.usage.output_tokens"],
        "cached": ["$.usage.cache_read_input_tokens"],
        "cache_write": ["$.usage.cache_creation_input_tokens"],
    },
    "google": {
        "input": ["$.usageMetadata.promptTokenCount", "$.usage_metadata.prompt_token_count"],
        "output": ["$.usageMetadata.candidatesTokenCount", "$.usage_metadata.candidates_token_count"],
        "reasoning": ["$.usageMetadata.thoughtsTokenCount", "$.usage_metadata.thoughts_token_count"],
    },
    "ollama": {"input": ["$.prompt_eval_count"], "output": ["$.eval_count"]},
    "bedrock": {"input": ["$.usage.inputTokens"], "output": ["$.usage.outputTokens"]},
}
#: A count that a provider reports apart although it belongs to another one.
FOLDED = {"anthropic": ("input", "cached"), "google": ("output", "reasoning")}
COUNTS = ("input", "output", "cached", "reasoning", "cache_write")


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, path: str, kind: str) -> Column:
    """Is there a value of this kind (STRING, ARRAY<, OBJECT) at the path?"""
    return F.coalesce(F.schema_of_variant(_at(value, path)).startswith(kind), F.lit(False))


def _string(value: Column, path: str) -> Column:
    """The string at a path; null for values of other kinds."""
    return F.when(_is(value, path, "STRING"), _at(value, path, "string"))


def chunks(response: Column) -> Column:
    """The chunks of a streamed response as ARRAY<VARIANT>, null for one that isn't a list."""
    return tx.let(strict_json(response), lambda v: F.when(_is(v, "$", "ARRAY<"), _at(v, "$", "array<variant>")))


def _counts(value: Column, paths: dict[str, list[str]], folded: tuple[str, str] | None) -> Column:
    number = lambda names: F.coalesce(*(_at(value, p, "bigint") for p in names)) if names else F.lit(None).cast("bigint")
    found = {c: number(paths.get(c, [])) for c in COUNTS}
    known = found["input"].isNotNull()
    found |= {c: F.coalesce(found[c], F.lit(0)) for c in COUNTS if c != "input"}
    if folded:
        found[folded[0]] = found[folded[0]] + found[folded[1]]
    return F.when(known, F.struct(*(found[c].cast("bigint").alias(c) for c in COUNTS), (found["input"] + found["output"]).alias("total")))


def usage_of(value: Column, provider: Column) -> Column:
    """STRUCT<input, output, cached, reasoning, cache_write, total> of one response (VARIANT) by its provider's rule.

    Cached input is part of the input and reasoning part of the output, also where a provider reports them apart. Providers that
    aren't named are read as chat completions or responses, whichever shape they have. Null without an input count.
    """
    case = F.when(F.lit(False), _counts(value, _CHAT_USAGE, None))
    for name, paths in USAGE_PATHS.items():
        case = case.when(provider == name, _counts(value, paths, FOLDED.get(name)))
    return case.otherwise(_counts(value, _CHAT_USAGE, None))


def usage(response: Column, provider: Column | None = None) -> Column:
    """The usage of a stored response, streamed or not, by the provider's rule (see ``usage_of`` and ``stream_usage``)."""
    provider = F.coalesce(provider, F.lit("")) if provider is not None else F.lit("")
    return tx.let(strict_json(response), lambda v: F.when(_is(v, "$", "ARRAY<"), _stream_usage(_at(v, "$", "array<variant>"), provider)).otherwise(usage_of(v, provider)))


def _joined(parts: Column) -> Column:
    """The texts of a list of blocks, joined; null if no block has one."""
    texts = F.filter(F.transform(parts, lambda b: _at(b, "$.text", "string")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def _blocks(value: Column, path: str) -> Column:
    return _joined(F.when(_is(value, path, "ARRAY<"), _at(value, path, "array<variant>")))


def text(response: Column) -> Column:
    """The assistant's text, whatever the shape of the response: all its text blocks, or all chunks of a stream in their order; null without any."""

    def of(v: Column) -> Column:
        shapes = [_string(v, "$.choices[0].message.content"), _blocks(v, "$.content"), _string(v, "$.message.content"), F.nullif(_string(v, "$.text"), F.lit("")), _blocks(v, "$.output.message.content")]
        gemini = _blocks(v, "$.candidates[0].content.parts")
        streamed = F.nullif(F.array_join(F.transform(_at(v, "$", "array<variant>"), chunk_text), ""), F.lit(""))
        whole = F.coalesce(F.nullif(_string(v, "$.output_text"), F.lit("")), *shapes, gemini)
        return F.when(_is(v, "$", "ARRAY<"), streamed).otherwise(whole)

    return tx.let(strict_json(response), of)


def _deltas(chunk: Column, field: str) -> Column:
    """A field of the deltas of all choices of a chunk, joined; null if none has it."""
    found = F.filter(F.transform(_at(chunk, "$.choices", "array<variant>"), lambda c: _string(c, f"$.delta.{field}")), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ""))


def chunk_text(chunk: Column) -> Column:
    """The visible text that one chunk (VARIANT) adds, whatever its provider; an empty text for none."""
    kind = _at(chunk, "$.type", "string")
    typed = F.when(kind == "response.output_text.delta", F.coalesce(_string(chunk, "$.delta"), F.lit(""))).when(kind == "content_block_delta", F.coalesce(_string(chunk, "$.delta.text"), F.lit("")))
    plain = [_string(chunk, p) for p in ("$.message.content", "$.text", "$.contentBlockDelta.delta.text")]
    return F.coalesce(_deltas(chunk, "content"), typed, *plain, _blocks(chunk, "$.candidates[0].content.parts"), F.lit(""))


def chunk_thinking(chunk: Column) -> Column:
    """The visible reasoning that one chunk adds; what is reasoned out of sight never reaches a recording."""
    block = F.when((_at(chunk, "$.type", "string") == "content_block_delta") & (_at(chunk, "$.delta.type", "string") == "thinking_delta"), _string(chunk, "$.delta.thinking"))
    return F.coalesce(block, _deltas(chunk, "reasoning_content"), _string(chunk, "$.message.thinking"), _string(chunk, "$.contentBlockDelta.delta.reasoningContent.text"), F.lit(""))


def thinking(response: Column) -> Column:
    """The visible reasoning of a streamed response, in order; an empty text for others."""
    return F.coalesce(F.array_join(F.transform(chunks(response), chunk_thinking), ""), F.lit(""))


def message_text(message: Column) -> Column:
    """The text of a message (VARIANT): its content, or the texts of the content's parts joined; an empty text without."""
    content = F.when(_is(message, "$.content", "ARRAY<"), F.array_join(F.transform(_at(message, "$.content", "array<variant>"), lambda p: F.coalesce(_at(p, "$.text", "string"), F.lit(""))), ""))
    return F.coalesce(content, _at(message, "$.content", "string"), F.lit(""))


def payload_text(payload: Column) -> Column:
    """The text that rules read of a payload: a JSON list's messages one a line, a message's text, else the payload as it is.

    A list's null elements are left out, and its elements that are no objects count with their value.
    """

    def of(v: Column) -> Column:
        elements = F.filter(_at(v, "$", "array<variant>"), lambda m: F.coalesce(F.schema_of_variant(m) != "VOID", F.lit(False)))
        listed = F.array_join(F.transform(elements, lambda m: F.when(_is(m, "$", "OBJECT"), message_text(m)).otherwise(_at(m, "$", "string"))), "\n")
        message = _is(v, "$", "OBJECT") & (_at(v, "$.content").isNotNull() | _at(v, "$.role").isNotNull())
        return F.when(_is(v, "$", "ARRAY<"), listed).when(message, message_text(v)).otherwise(payload)

    return F.when(payload.isNotNull(), tx.let(strict_json(payload), of))


def attributes(attrs: Column) -> Column:
    """STRUCT<model, provider, input, output, cached, reasoning> from a map of telemetry attributes, by the first alias that is set.

    Counts are whole numbers; all are null without an input count, and the others 0 where they are missing.
    """
    pick = lambda *names: F.coalesce(*(F.try_element_at(attrs, F.lit(n)) for n in names))
    count = lambda *names: pick(*names).try_cast("double").cast("bigint")
    used = count("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens")
    rest = lambda *names: F.when(used.isNotNull(), F.coalesce(count(*names), F.lit(0)))
    return F.struct(
        F.coalesce(pick("gen_ai.request.model", "gen_ai.response.model"), F.lit("")).alias("model"),
        F.coalesce(pick("gen_ai.system", "gen_ai.provider.name"), F.lit("")).alias("provider"),
        used.alias("input"),
        rest("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens").alias("output"),
        rest("gen_ai.usage.cached_tokens", "gen_ai.usage.cache_read_input_tokens").alias("cached"),
        rest("gen_ai.usage.reasoning_tokens").alias("reasoning"),
    )


def spans(calls: DataFrame) -> DataFrame:
    """Calls (model, ts, latency_ms, tokens ...) as spans: start, end and a map of the attributes that are set."""
    end = F.col("ts")
    start = end - F.make_dt_interval(secs=(F.coalesce("latency_ms", F.lit(0.0)) / 1000).cast("decimal(18,6)"))
    names = ["model", "input_tokens", "output_tokens", "reasoning_tokens"]
    filled = F.map_from_arrays(F.array(*(F.lit(f"gen_ai.{n}") for n in names)), F.array(*(F.col(n).cast("string") for n in names)))
    kept = F.map_filter(filled, lambda k, v: v.isNotNull() & ~((k == "gen_ai.reasoning_tokens") & (v == "0")))
    return calls.withColumn("start", start).withColumn("end", end).withColumn("attributes", kept)


def roots(runs: DataFrame, run: str, parent: str, rounds: int = 40) -> DataFrame:
    """(run, root, depth): the topmost known ancestor of each run.

    Pointers are doubled: every round replaces a run's pointer by its pointer's pointer, so a depth of n takes log2(n) rounds.
    Runs that have reached their root leave the join. A run in a cycle, or with an unknown parent, is its own root above that point.
    """
    rows = runs.filter(F.col(run).isNotNull()).groupBy(run).agg(F.min(parent).alias(parent))
    known = rows.select(F.col(run).alias("k"))
    start = rows.join(known, F.col(parent) == F.col("k"), "left")
    start = start.select(F.col(run).alias("run"), F.when(F.col("k") != F.col(run), F.col("k")).alias("up"), F.lit(0).alias("depth"))
    state = written(start.select("run", F.coalesce("up", "run").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), F.col("up").isNull().alias("done")), "roots")
    for _ in range(rounds):
        todo = state.filter("NOT done")
        if todo.isEmpty():
            break
        above = state.select(F.col("run").alias("a"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("done").alias("a_done"))
        moved = todo.join(above, F.col("up") == F.col("a")).select(
            "run", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_done").alias("done")
        )
        new = written(state.filter("done").unionByName(moved), "roots")
        dropped(state)
        state = new
    return state.select(F.col("run").alias(run), F.when(F.col("done"), F.col("up")).otherwise(F.col("run")).alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(0).alias("depth"))


def stream_usage(response: Column, provider: Column) -> Column:
    """The usage of a streamed response by the provider's rule, null for other responses and without an input count.

    anthropic: start and last delta together, cached input added; google: the last chunk, as each holds the totals so far;
    bedrock: the metadata event; openai_responses: the nested response; all others: the first chunk with a usage.
    """
    return tx.let(chunks(response), lambda parts: _stream_usage(parts, provider))


def _stream_usage(parts: Column, provider: Column) -> Column:
    first = lambda test: F.get(F.filter(parts, test), 0)
    kind = lambda c: _at(c, "$.type", "string")
    start = first(lambda c: kind(c) == "message_start")
    last = F.try_element_at(F.filter(parts, lambda c: (kind(c) == "message_delta") & _at(c, "$.usage.output_tokens", "bigint").isNotNull()), F.lit(-1))
    zero = lambda c, p: F.coalesce(_at(c, p, "bigint"), F.lit(0))
    merged = {
        "input": _at(start, "$.message.usage.input_tokens", "bigint") + zero(start, "$.message.usage.cache_read_input_tokens"),
        "output": zero(last, "$.usage.output_tokens"),
        "cached": zero(start, "$.message.usage.cache_read_input_tokens"),
        "reasoning": F.lit(0),
        "cache_write": zero(start, "$.message.usage.cache_creation_input_tokens"),
    }
    two = F.when(merged["input"].isNotNull(), F.struct(*(merged[c].cast("bigint").alias(c) for c in COUNTS), (merged["input"] + merged["output"]).alias("total")))
    event = _at(first(lambda c: _at(c, "$.metadata.usage").isNotNull()), "$.metadata")
    nested = _at(first(lambda c: _at(c, "$.response.usage").isNotNull()), "$.response")
    found = F.filter(F.transform(parts, lambda c: usage_of(c, provider)), lambda u: u.isNotNull())
    return (
        F.when(provider == "anthropic", two)
        .when(provider == "bedrock", usage_of(event, F.lit("bedrock")))
        .when(provider == "openai_responses", usage_of(nested, F.lit("openai_responses")))
        .when(provider == "google", F.try_element_at(found, F.lit(-1)))
        .otherwise(F.get(found, 0))
    )


def message_tokens(messages: Column) -> Column:
    """Estimated tokens of ARRAY<VARIANT> messages: what a context and each message cost, and their texts; 0 without messages."""
    each = F.transform(messages, lambda m: tx.token_estimate(message_text(m)) + PER_MESSAGE)
    return F.when(F.size(messages) > 0, F.aggregate(each, F.lit(PRIMING).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def estimated_usage(messages: Column, response_text: Column, thinking_text: Column | None = None) -> Column:
    """STRUCT<input, output, reasoning, estimated> by the token heuristic, for streams that carry no usage; visible thinking is output too."""
    count = lambda t: F.coalesce(tx.token_estimate(t), F.lit(0))
    reasoned = count(thinking_text) if thinking_text is not None else F.lit(0).cast("long")
    return F.struct(F.coalesce(message_tokens(messages), F.lit(0)).alias("input"), (count(response_text) + reasoned).alias("output"), reasoned.alias("reasoning"), F.lit(True).alias("estimated"))


def first_token_ms(chunk_times: Column, start: Column) -> Column:
    """Milliseconds from the start of a call to its first chunk; null without chunks."""
    return (F.unix_micros(F.array_min(chunk_times)) - F.unix_micros(start)) / F.lit(1000.0)


#: Where a run's result keeps its usage, in the order in which the places are tried.
_RUN_USAGE = {
    "input": ["promptTokens", "prompt_tokens", "input_tokens"],
    "output": ["completionTokens", "completion_tokens", "output_tokens"],
}


def run_usage(result: Column) -> Column:
    """STRUCT<input, output, cached, reasoning, cache_write> of a run's result: a generation's own usage, else that of the whole output.

    A count that is no number is 0; null where the result has no usage at all.
    """

    def number(v: Column, *paths: str) -> Column:
        return F.coalesce(F.coalesce(*(_at(v, p, "string") for p in paths)).try_cast("double").cast("bigint"), F.lit(0))

    def row(i: Column, o: Column, c: Column, r: Column, w: Column) -> Column:
        return F.struct(i.alias("input"), o.alias("output"), c.alias("cached"), r.alias("reasoning"), w.alias("cache_write"))

    def of(v: Column) -> Column:
        every = F.flatten(_at(v, "$.generations", "array<array<variant>>"))
        own = F.get(F.filter(F.transform(every, lambda g: _at(g, "$.message.usage_metadata")), lambda m: _truthy(m)), 0)
        whole = F.coalesce(*(F.when(_truthy(_at(v, f"$.llmOutput.{n}")), _at(v, f"$.llmOutput.{n}")) for n in ("tokenUsage", "token_usage", "usage")))
        of_own = row(
            number(own, "$.input_tokens"), number(own, "$.output_tokens"), number(own, "$.input_token_details.cache_read"), number(own, "$.output_token_details.reasoning"), number(own, "$.input_token_details.cache_creation")
        )
        of_whole = row(
            number(whole, *(f"$.{n}" for n in _RUN_USAGE["input"])), number(whole, *(f"$.{n}" for n in _RUN_USAGE["output"])), number(whole, "$.prompt_tokens_details.cached_tokens", "$.promptTokensDetails.cachedTokens"),
            number(whole, "$.completion_tokens_details.reasoning_tokens", "$.completionTokensDetails.reasoningTokens"), F.lit(0).cast("bigint"),
        )
        return F.when(own.isNotNull(), of_own).when(whole.isNotNull(), of_whole)

    return tx.let(strict_json(result), of)


def _truthy(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) != "VOID", F.lit(False))


def run_model(result: Column) -> Column:
    """The model of a run's result: that of the whole output, else of the first generation that names one; empty if none does."""

    def of(v: Column) -> Column:
        named = F.filter(
            F.transform(F.flatten(_at(v, "$.generations", "array<array<variant>>")), lambda g: F.coalesce(_at(g, "$.message.response_metadata.model_name", "string"), _at(g, "$.message.response_metadata.model", "string"))),
            lambda m: m != "",
        )
        whole = F.coalesce(*(_at(v, f"$.llmOutput.{n}", "string") for n in ("model_name", "modelName", "model")))
        return F.coalesce(F.nullif(whole, F.lit("")), F.get(named, 0), F.lit(""))

    return F.coalesce(tx.let(strict_json(result), of), F.lit(""))


def nearest_names(runs: DataFrame, run: str, parent: str, name: str, rounds: int = 40) -> DataFrame:
    """(run, agent): the name of the run itself, or else of its nearest ancestor that has one; null if none has.

    Pointers are doubled as in ``roots``; a run leaves the join as soon as it has met a name or the top of its tree.
    """
    rows = runs.filter(F.col(run).isNotNull()).groupBy(run).agg(F.min(parent).alias("up"), F.min(F.nullif(name, F.lit(""))).alias("agent"))
    known = rows.select(F.col(run).alias("k"))
    rows = rows.join(known, F.col("up") == F.col("k"), "left").select(F.col(run).alias("run"), F.when(F.col("k") != F.col(run), F.col("k")).alias("up"), "agent")
    state = written(rows.withColumn("done", F.col("agent").isNotNull() | F.col("up").isNull()), "names")
    for _ in range(rounds):
        todo = state.filter("NOT done")
        if todo.isEmpty():
            break
        above = state.select(F.col("run").alias("a"), F.col("up").alias("a_up"), F.col("agent").alias("a_agent"), F.col("done").alias("a_done"))
        moved = todo.join(above, F.col("up") == F.col("a")).select("run", F.col("a_up").alias("up"), F.col("a_agent").alias("agent"), F.col("a_done").alias("done"))
        new = written(state.filter("done").unionByName(moved), "names")
        dropped(state)
        state = new
    return state.select(F.col("run").alias(run), F.when(F.col("done"), F.col("agent")).alias("agent"))


def run_calls(events: DataFrame) -> DataFrame:
    """Start and end events of runs as finished calls: (run, parent, kind, name, input, output, error, usage, model, root, agent).

    ``events`` has run, parent, event (start, end, error), kind (chain, llm, tool), name, body. A run that never ended gives no call, one without a
    start is called ``tool``; a run that ended twice counts once. Chains only name their descendants.
    """
    of = lambda kind, column: F.min(F.when(F.col("event") == kind, F.col(column)))
    runs = events.filter("run IS NOT NULL").groupBy("run").agg(
        F.min("parent").alias("parent"), F.min("kind").alias("kind"), of("start", "name").alias("name"), of("start", "body").alias("input"), of("end", "body").alias("output"),
        of("error", "body").alias("error"), F.count_if(F.col("event").isin("end", "error")).alias("ends"),
    )
    runs = written(runs, "runs")
    rooted = roots(runs, "run", "parent").select("run", "root")
    named = nearest_names(runs.withColumn("own", F.when(F.col("kind") == "chain", F.col("name"))), "run", "parent", "own")
    calls = runs.filter("ends > 0 AND kind <> 'chain'").drop("ends").join(rooted, "run").join(named, "run")
    calls = calls.withColumn("usage", F.when(F.col("kind") == "llm", run_usage(F.col("output")))).withColumn("model", F.when(F.col("kind") == "llm", run_model(F.col("output"))))
    return calls.withColumn("name", F.when(F.col("kind") == "tool", F.coalesce("name", F.lit("tool"))).otherwise(F.col("name")))


def carried(events: DataFrame, session: str, order: list[str], name: Column, clears: Column) -> DataFrame:
    """``events`` with ``agent``: the name set last in the session, null after an event that clears it.

    An event that sets or clears begins a segment; the running number of segments is distributed, and the segment's name is
    joined by (session, segment). A long session is spread over many tasks.
    """
    rows = events.withColumn("__name", name).withColumn("__sets", (F.col("__name").isNotNull() | F.coalesce(clears, F.lit(False))).cast("long"))
    rows = ordered.running(rows, session, [F.col(c) for c in order], ["__sets"], "agents")
    rows = rows.withColumn("__segment", F.col("before___sets") + F.col("__sets"))
    names = rows.filter("__sets = 1").select(F.col(session).alias("__s"), F.col("__segment").alias("__n"), F.col("__name").alias("agent"))
    out = rows.join(names, rows[session].eqNullSafe(names["__s"]) & (rows["__segment"] == names["__n"]), "left")
    return out.select(*events.columns, "agent")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A red-team corpus (text, label, category, id) from JSON lines, a JSON array or CSV; the label defaults to attack."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
    else:
        rows = spark.read.option("multiLine", path.endswith(".json")).json(path)
    have = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("text", "label", "category", "id")}
    rows = rows.select(*(v.cast("string").alias(k) for k, v in have.items())).filter("text IS NOT NULL")
    return rows.withColumn("label", F.coalesce("label", F.lit("attack")))
