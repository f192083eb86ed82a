"""Structured Streaming operators with state.  They need the RocksDB state store
(``use_rocksdb``); every per-key order is restored from a sequence number."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuesheet.functions import text as tx
from cuesheet.streaming.scanner import SCANNER_SCHEMA, Scanner


IN_MEMORY = 10_000  # early rows of one key held in memory before they move to the state store
PAGE = 256  # numbers whose early rows share an entry of the state store


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


class InOrder(StatefulProcessor):
    """Hands rows of a key on in ``seq`` order 1, 2, ...; later rows wait in a map for the gap to fill.

    Every access to state goes through a socket, so rows wait by the page (``PAGE`` numbers): a page has as many parts as times rows of
    it were put away, and is taken back as a whole when its turn comes.  State is read only for keys that have some.
    Rows that were already handed on (a replay from the source) are ignored.  A key ends when ``take`` sets ``ended``, or, with
    ``idle_ms``, when a timer finds that no row has come for that long; then ``last_rows`` gives what is
    confirmed by then, rows still waiting behind a gap are given up, and all state of the key is cleared but for an end mark.  The mark
    keeps replays and late rows out; with ``idle_ms`` it lives for ``mark_ms`` (ten times ``idle_ms``) and is then
    forgotten as well.  Without ``idle_ms`` nothing expires: a mark is one number per ended key.  Timers need the
    processing-time mode, whose queries never run out of batches.
    """

    fields: str  # "name type, name type": what is kept of a waiting row

    def __init__(self, idle_ms: int | None = None, mark_ms: int | None = None):
        super().__init__()
        self.idle_ms = idle_ms
        self.mark_ms = None if idle_ms is None else mark_ms or 10 * idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.fields.split(",")]
        self.waiting = handle.getMapState("waiting", "page bigint, part bigint", "rows string")
        self.place = handle.getValueState("place", "next bigint, parts string")
        self.mark = handle.getValueState("mark", "next bigint", self.mark_ms)
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key, row: Row) -> Iterator[Row]:
        raise NotImplementedError

    def begin(self) -> None:
        """Load state once per batch; ``known`` says that an earlier batch left some."""

    def finish(self) -> None:
        """Store state once per batch."""

    def last_rows(self, key) -> Iterator[Row]:
        """What a key that ends by time still has to give."""
        return iter(())

    def forget(self) -> None:
        """Clear state of a key that has ended."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.mark.exists():
            return
        turn, parts = self._open()
        fresh: dict[int, Row] = {}
        self.ended = False
        for row in rows:
            if self.ended or row.seq < turn:
                continue
            fresh[row.seq] = row
            while not self.ended:
                if turn in fresh:
                    yield from self.take(key, fresh.pop(turn))
                    turn += 1
                elif turn // PAGE in parts:
                    self._fetch(turn, parts, fresh)
                else:
                    break
            if len(fresh) > IN_MEMORY + PAGE:
                self._hold(fresh, parts)
        if self.ended:
            self._end(turn)
            return
        self._hold(fresh, parts)
        self.place.update((turn, json.dumps(list(parts.items()))))
        self.finish()
        if self.idle_ms is not None:
            self._stop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        turn, _ = self._open()
        yield from self.last_rows(key)
        self._end(turn)

    def _open(self) -> tuple[int, dict[int, int]]:
        """The next number, and how many parts of which pages wait."""
        place = self.place.get()
        self.known = self.stored = place is not None
        self.begin()
        return (place[0], dict(json.loads(place[1]))) if place else (1, {})

    def _end(self, turn: int) -> None:
        if self.stored:
            self.waiting.clear()
            self.place.clear()
            self.forget()
        self.mark.update((turn,))
        if self.idle_ms is not None:
            self._stop_timers()

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _hold(self, fresh: dict[int, Row], parts: dict[int, int]) -> None:
        """Move rows that came too early to the state store."""
        pages: dict[int, list] = {}
        for seq, row in fresh.items():
            pages.setdefault(seq // PAGE, []).append([seq, *[row[c] for c in self.names]])
        for page, rows in pages.items():
            part = parts.get(page, 0)
            self.waiting.updateValue((page, part), (json.dumps(rows),))
            parts[page] = part + 1
        self.stored |= bool(pages)
        fresh.clear()

    def _fetch(self, turn: int, parts: dict[int, int], fresh: dict[int, Row]) -> None:
        """Take the page of ``turn`` back; of rows with one number the latest counts."""
        page, make = turn // PAGE, Row(*self.names)
        for part in reversed(range(parts.pop(page))):
            for seq, *values in json.loads(self.waiting.getValue((page, part))[0]):
                if seq >= turn:
                    fresh.setdefault(seq, make(*values))
            self.waiting.removeKey((page, part))

    def close(self) -> None:
        pass


class TranscriptProcessor(InOrder):
    """Chunks of a transcript -> segments as soon as they are confirmed."""

    fields = "chunk string, eof boolean"

    def open_state(self, handle):
        self.scan = handle.getValueState("scanner", SCANNER_SCHEMA)
        self.count = handle.getValueState("count", "n bigint")

    def begin(self):
        self.scanner = Scanner(*self.scan.get()) if self.known else Scanner()
        self.done = self.count.get()[0] if self.known else 0

    def take(self, key, row):
        found = self.scanner.feed(row.chunk or "")
        if row.eof:
            found += self.scanner.close()
            self.ended = True
        yield from self._rows(key, found)

    def last_rows(self, key):
        yield from self._rows(key, self.scanner.close())

    def _rows(self, key, found):
        for start, end, speaker, text in found:
            self.done += 1
            yield Row(media_id=key[0], idx=self.done, start_ms=int(start * 1000 + 0.5), end_ms=int(end * 1000 + 0.5), speaker=speaker, text=text)

    def finish(self):
        self.scan.update(self.scanner.to_row())
        self.count.update((self.done,))

    def forget(self):
        self.scan.clear()
        self.count.clear()


class PhraseProcessor(InOrder):
    """The repeated-phrase guard on an unbounded stream of segments."""

    fields = "idx bigint, text string, phrase string, short boolean"
    max_run, max_total = 3, 24

    def open_state(self, handle):
        self.last = handle.getValueState("last", "phrase string, run bigint")
        self.totals = handle.getMapState("totals", "phrase string", "n bigint")

    def begin(self):
        self.phrase, self.run = self.last.get() if self.known else ("", 0)
        self.seen, self.changed = {}, set()

    def take(self, key, row):
        keep = True
        if row.phrase is None:  # a blank row never reaches the guard
            keep = False
        elif not row.short:
            self.phrase, self.run = "", 0
        else:
            self.run = self.run + 1 if row.phrase == self.phrase else 1
            self.phrase = row.phrase
            total = self._total(row.phrase) + 1
            self.seen[row.phrase] = total
            self.changed.add(row.phrase)
            keep = self.run <= self.max_run and total <= self.max_total
            if len(self.seen) > IN_MEMORY:
                self._put_totals()
        if keep:
            yield Row(media_id=key[0], idx=row.idx, text=row.text)

    def _total(self, phrase):
        if phrase in self.seen:
            return self.seen[phrase]
        return self.totals.getValue((phrase,))[0] if self.stored and self.totals.containsKey((phrase,)) else 0

    def _put_totals(self):
        for phrase in self.changed:
            self.totals.updateValue((phrase,), (self.seen[phrase],))
        self.stored |= bool(self.changed)
        self.seen.clear()
        self.changed.clear()

    def finish(self):
        self._put_totals()
        self.last.update((self.phrase, self.run))

    def forget(self):
        self.last.clear()
        self.totals.clear()


class DeltaProcessor(InOrder):
    """Server-sent lines -> one row per stream at its end: text and the last usage figures.

    The pieces of a batch go to a list state together, so a growing text is never rewritten.
    """

    fields = "line string"

    def open_state(self, handle):
        self.pieces = handle.getListState("pieces", "piece string")
        self.usage = handle.getValueState("usage", "prompt bigint, completion bigint")

    def begin(self):
        self.prompt, self.completion = self.usage.get() if self.known else (None, None)
        self.new: list[str] = []

    def take(self, key, row):
        line = (row.line or "").strip()
        if not line.startswith("data:"):
            return
        data = line[5:].strip()
        if data == "[DONE]":
            yield self._whole_row(key)
            self.ended = True
            return
        try:
            chunk = json.loads(data)
        except ValueError:  # noise between the lines
            return
        if not isinstance(chunk, dict):
            return
        usage = _fields(chunk.get("usage"))
        self.prompt = _whole(usage.get("prompt_tokens"), self.prompt)
        self.completion = _whole(usage.get("completion_tokens"), self.completion)
        choices = chunk.get("choices")
        for choice in choices if isinstance(choices, list) else []:
            piece = _fields(_fields(choice).get("delta")).get("content")
            if piece and isinstance(piece, str):
                self.new.append(piece)
                if len(self.new) > IN_MEMORY:
                    self._put_pieces()

    def _put_pieces(self):
        if self.new:
            self.pieces.appendValue(("".join(self.new),))
            self.stored, self.new = True, []

    def _whole_row(self, key):
        text = "".join([*(p[0] for p in self.pieces.get()), *self.new] if self.stored else self.new)
        return Row(stream_id=key[0], text=text, prompt_tokens=self.prompt, completion_tokens=self.completion)

    def last_rows(self, key):
        """A stream that breaks off gives what has come."""
        yield self._whole_row(key)

    def finish(self):
        self._put_pieces()
        self.usage.update((self.prompt, self.completion))

    def forget(self):
        self.pieces.clear()
        self.usage.clear()


def _fields(value) -> dict:
    return value if isinstance(value, dict) else {}


def _whole(value, before: int | None) -> int | None:
    """A count, or the one before where none is given."""
    return value if isinstance(value, int) and not isinstance(value, bool) else before


class TokenProcessor(InOrder):
    """Tokens generated so far; the first put of a stream is the prompt and does not count."""

    fields = "tokens bigint"

    def open_state(self, handle):
        self.sum = handle.getValueState("sum", "n bigint, prompt boolean")

    def begin(self):
        self.n, self.prompt = self.sum.get() if self.known else (0, False)

    def take(self, key, row):
        if not self.prompt:
            self.prompt = True
            return
        self.n += row.tokens
        yield Row(stream_id=key[0], generated=self.n)

    def finish(self):
        self.sum.update((self.n, self.prompt))

    def forget(self):
        self.sum.clear()


class ThrottleProcessor(InOrder):
    """Status events to persist: live progress at most every 0.5 s, everything else always."""

    fields = "at_ms bigint, status string, progress double, live boolean"
    every_ms = 500

    def open_state(self, handle):
        self.saved = handle.getValueState("saved", "at bigint")

    def begin(self):
        saved = self.saved.get() if self.known else None
        self.at = saved[0] if saved else None

    def take(self, key, row):
        keep = not row.live or self.at is None or row.at_ms - self.at >= self.every_ms
        if keep and row.live:
            self.at = row.at_ms
        if keep:
            yield Row(job_id=key[0], at_ms=row.at_ms, status=row.status, progress=row.progress)

    def finish(self):
        if self.at is not None:
            self.saved.update((self.at,))

    def forget(self):
        self.saved.clear()


class CancelProcessor(StatefulProcessor):
    """Events and cancellations of a job in one stream; the time of the first cancellation stays in the state.

    Of a batch, cancellations count first, wherever they stand in it, so that a result depends on what has arrived and
    not on its order.  With ``mark_ms`` a cancellation is forgotten that long after it came.
    """

    def __init__(self, mark_ms: int | None = None):
        super().__init__()
        self.idle_ms = self.mark_ms = mark_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cancelled = handle.getValueState("cancelled", "at bigint", self.mark_ms)
        self.early = handle.getListState("early", "at bigint, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.cancelled.get()
        known = found[0] if found else None
        at, events, stored = known, [], False
        for row in rows:
            if row.event is None:
                at = row.cancel_ms if at is None else min(at, row.cancel_ms)
            elif at is None or row.at_ms < at:
                events.append((row.at_ms, row.event))
            if len(events) > IN_MEMORY:
                self.early.appendList(events)
                events, stored = [], True
        if at != known:
            self.cancelled.update((at,))
        for many in (self.early.get() if stored else (), events):
            for when, event in many:
                if at is None or when < at:
                    yield Row(job_id=key[0], event=event)
        if stored:
            self.early.clear()

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    mode = "None" if processor.idle_ms is None else "ProcessingTime"
    return df.groupBy(key).transformWithState(processor, outputStructType=T.StructType.fromDDL(schema), outputMode="Append", timeMode=mode)


def _key(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}"


def parse_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """chunks (media_id, seq from 1, chunk, eof) -> segments; any chunking gives the same rows."""
    schema = f"{_key(chunks, 'media_id')}, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"
    return _run(chunks, "media_id", TranscriptProcessor(idle_ms), schema)


def guard_stream(segments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """segments (media_id, seq from 1, idx, text) without repeated short phrases."""
    phrase = tx.normal_phrase(F.col("text"))
    rows = segments.select(
        "media_id", "seq", "idx", "text", F.when(F.length(tx.strip(F.col("text"))) > 0, phrase).alias("phrase"), tx.is_short_phrase(phrase).alias("short")
    )
    return _run(rows, "media_id", PhraseProcessor(idle_ms), f"{_key(segments, 'media_id')}, idx bigint, text string")


def fold_deltas_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """lines (stream_id, seq from 1, line) -> (stream_id, text, prompt_tokens, completion_tokens) at [DONE]."""
    return _run(lines, "stream_id", DeltaProcessor(idle_ms), f"{_key(lines, 'stream_id')}, text string, prompt_tokens bigint, completion_tokens bigint")


def count_tokens_stream(puts: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """puts (stream_id, seq from 1, tokens) -> running token counts."""
    return _run(puts, "stream_id", TokenProcessor(idle_ms), f"{_key(puts, 'stream_id')}, generated bigint")


def throttle_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """events (job_id, seq from 1, at_ms, status, progress, live) -> those to persist."""
    return _run(events, "job_id", ThrottleProcessor(idle_ms), f"{_key(events, 'job_id')}, at_ms bigint, status string, progress double")


def latest_status_stream(events: DataFrame) -> DataFrame:
    """Latest status per job, in update mode: a plain streaming aggregate."""
    latest = F.max_by(F.struct("status", "progress", "at_ms"), F.struct("at_ms", "event_id"))
    return events.groupBy("job_id").agg(latest.alias("s")).select("job_id", "s.status", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s.progress")).alias("progress"), "s.at_ms")


def without_cancelled(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Events of jobs that are cancelled or deleted already; works on streams (stream-static anti join)."""
    return events.join(cancelled.select("job_id").distinct(), "job_id", "left_anti")


def until_cancelled(events: DataFrame, cancels: DataFrame, mark_ms: int | None = None) -> DataFrame:
    """events (job_id, at_ms, ...) before their job's cancellation, from streams of both; cancels: job_id, cancel_ms.

    A cancellation may come at any time: events at or after ``cancel_ms`` that arrive with it or later are dropped,
    also after the job has ended.  What came out in earlier batches stays.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    packed = F.to_json(F.struct(*[events[c] for c in events.columns]), exact)
    rows = events.select("job_id", "at_ms", F.lit(None).cast("bigint").alias("cancel_ms"), packed.alias("event"))
    marks = cancels.select("job_id", F.lit(None).cast("bigint").alias("at_ms"), "cancel_ms", F.lit(None).cast("string").alias("event"))
    out = _run(rows.unionByName(marks), "job_id", CancelProcessor(mark_ms), f"{_key(events, 'job_id')}, event string")
    return out.select(F.from_json("event", events.schema, exact).alias("e")).select("e.*")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the stream into a table and read it back."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
