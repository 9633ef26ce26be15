"""Structured Streaming: budgets with state, streamed calls put together, counters in windows, fan-out and chain writing.

Every function takes a streaming DataFrame (a batch one where it says so) and leaves the start to the caller, or to
``run_available`` which processes what is there and stops. State is keyed and bounded by the number of open keys.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import ledger
from tidemark.storage import shared_dir


def budgets(calls: DataFrame, cap_usd: str) -> DataFrame:
    """Calls (key, call_id, ts, usd DECIMAL) with ``allowed`` and what the key has spent; blocked calls don't accrue.

    Within a micro-batch the calls of a key are taken by (ts, call_id), three numbers a call; the state is one number per key. Money is
    counted in whole billionths.
    """
    cap = int(Decimal(cap_usd).scaleb(9))
    nano = (F.coalesce(F.col("usd").cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)")) * 1_000_000_000).cast("long")
    rows = calls.select("key", "call_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), nano.alias("nano"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        held = [batch[["at", "call_id", "nano"]].to_numpy(dtype="int64") for batch in batches]
        own = np.concatenate(held)
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        allowed, after = np.zeros(len(own), bool), np.zeros(len(own), np.int64)
        for i, usd in enumerate(own[:, 2].tolist()):
            if spent + usd <= cap:
                spent += usd
                allowed[i] = True
            after[i] = spent
        state.update((spent,))
        yield pd.DataFrame({"key": key[0], "call_id": own[:, 1], "allowed": allowed, "nano": after})

    out = rows.groupBy("key").applyInPandasWithState(step, "key string, call_id long, allowed boolean, nano long", "spent long", "append", GroupStateTimeout.NoTimeout)
    spent = (F.col("nano").cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(38,9)")
    return out.select("key", "call_id", "allowed", spent.alias("spent"))


def calls_from_chunks(chunks: DataFrame, idle_ms: int = 60_000, max_tokens: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """Chunks (call_id, idx, text, last) put together, each call once: when its last chunk came or after ``idle_ms``.

    With ``max_tokens`` a call is cut (``broken``) as soon as its running estimate of a quarter of its characters is over the bound. A call
    that was emitted is remembered for ``forget_ms`` (ten times ``idle_ms`` unless given), so that late chunks don't open it again.
    """
    forget = 10 * idle_ms if forget_ms is None else forget_ms

    def emit(call: str, parts: dict, broken: bool) -> pd.DataFrame:
        text = "".join(parts[k] for k in sorted(parts, key=int))
        return pd.DataFrame([(call, text, len(parts), broken)], columns=["call_id", "text", "chunks", "broken"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, parts = (state.get[1], json.loads(state.get[0])) if state.exists else (False, {})
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            state.update((json.dumps({}), True))
            state.setTimeoutDuration(forget)
            yield emit(key[0], parts, False)
            return
        last = broken = False
        for batch in batches:
            for idx, text, end in batch.sort_values("idx")[["idx", "text", "last"]].itertuples(index=False):
                parts.setdefault(str(idx), text or "")
                last |= bool(end)
        if done:
            return
        if max_tokens is not None:
            broken = sum(map(len, parts.values())) > 4 * max_tokens
        if last or broken:
            yield emit(key[0], parts, broken)
        state.update((json.dumps({} if last or broken else parts), last or broken))
        state.setTimeoutDuration(forget if last or broken else idle_ms)

    schema = "call_id string, text string, chunks int, broken boolean"
    return chunks.groupBy("call_id").applyInPandasWithState(step, schema, "parts string, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def counters(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, key, tokens) counted per window and key; an extension, as the calls themselves know no event time windows."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "key")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "key", "n", "tokens")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to all sinks; every sink runs, then the first error is raised."""

    def write(batch: DataFrame, batch_id: int) -> None:
        errors = []
        for sink in sinks:
            try:
                sink(batch, batch_id)
            except Exception as e:  # noqa: BLE001
                errors.append(e)
        if errors:
            raise errors[0]

    return write


def append_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch once: a repeated batch replaces its own folder."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def chain_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends a batch (ts, type, payload as JSON) to a hash chain, continuing at the last line of the batch before.

    ``path`` is a folder of any file system that the cluster shares. A chain is sequential by nature: rows come to the single writer one
    partition at a time, in order, and one file holds a batch; a batch that is repeated writes its file again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        files = {f.getPath().getName(): f for f in fs.listStatus(folder)}
        earlier = [n for n, f in files.items() if n.endswith(".jsonl") and int(n[:-6]) < batch_id and f.getLen() > 0]
        prev, seq = ledger.GENESIS, 0
        if earlier:
            row = json.loads(spark.read.text(files[max(earlier)].getPath().toString()).tail(1)[0][0])
            prev, seq = row["hash"], row["seq"] + 1
        temporary, final = (jvm.org.apache.hadoop.fs.Path(folder, f"{batch_id:012d}.{kind}") for kind in ("tmp", "jsonl"))
        out = fs.create(temporary, True)
        try:
            for row in batch.orderBy("ts", "type", "payload").toLocalIterator():
                payload = json.loads(row["payload"])
                own = ledger.entry_hash(prev, seq, row["ts"], row["type"], payload)
                line = ledger.canonical_text({"seq": seq, "ts": row["ts"], "type": row["type"], "payload": payload, "prev_hash": prev, "hash": own}) + "\n"
                out.write(bytearray(line.encode("utf-8", "surrogatepass")))
                prev, seq = own, seq + 1
        finally:
            out.close()
        fs.delete(final, False)
        fs.rename(temporary, final)

    return write


def read_table(spark: SparkSession, directory: str, name: str, files_a_batch: int = 1000) -> DataFrame:
    """A parquet table as a stream."""
    folder, file = directory.rstrip("/"), f"{name}.parquet"
    table = spark.read.parquet(f"{folder}/{file}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_a_batch)
    if any(x.rstrip("/").endswith(f"/{file}") for x in table.inputFiles()[:1]):  # one file: a stream reads folders
        return stream.option("pathGlobFilter", file).parquet(folder)
    return stream.parquet(f"{folder}/{file}")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, idle_ms: int | None = None) -> None:
    """Process everything that is there with a checkpoint in the shared folder, then stop.

    State with timeouts always asks for one more batch: give its ``idle_ms``, and the stream goes on for that long after its input is used
    up, so that what is still open times out and is emitted.
    """
    import uuid

    at = f"{shared_dir(stream.sparkSession)}/tidemark/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", at)
    if idle_ms is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    used_up, seen = None, -1
    try:
        while query.isActive:
            last = query.lastProgress
            if last is not None and last["batchId"] != seen:
                seen = last["batchId"]
                if last["numInputRows"] > 0:
                    used_up = None
                elif used_up is None:
                    used_up = time.monotonic()
                elif time.monotonic() - used_up > idle_ms / 1000 + last["durationMs"].get("triggerExecution", 0) / 1000 + 1:
                    break  # a batch that began after the last timeout was due is over
            time.sleep(0.05)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
