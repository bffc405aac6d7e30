"""Progress of running tasks as keyed streaming state."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reapline.streaming.ledger import columns_of

STATE_VERSION = 4
BUCKET = 64  # records of a run in one stored value, about
PAGES = 1024  # pages in one stored value

STEP = ("seq", "pos", "kind", "page_number", "identity", "record", "min_items", "target_pages", "scroll_rounds", "until_text")

PROGRESS_OUT = (
    "thread_id string, seq bigint, item_count bigint, completed_pages int, stagnant_rounds int, scroll_round int, "
    "stop_condition_met boolean, is_done boolean, state_version int"
)


def _present(value) -> bool:
    return value is not None and value is not False and (not isinstance(value, str) or bool(value.strip())) and value not in ([], {})


class ProgressProcessor(StatefulProcessor):
    """Merged records, pages, scroll rounds and stop condition of one run.

    Records live in map state by identity: the run may collect any number of them without
    one value growing.  A record is read once a batch, and written once if it changed; pages are bits,
    ``PAGES`` to a value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "identity string", "record string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("page_bits", "part int", "bits binary")
        self.totals = handle.getValueState("totals", "items bigint, pages int, stagnant int, round int, met boolean")

    def stored_records(self, identities: Iterable[str], items: int) -> dict[str, str]:
        """Those of ``identities`` that the run holds; it holds ``items`` in all."""
        found = {i: self.records.getValue((i,)) for i in identities}
        return {i: text[0] for i, text in found.items() if text is not None}

    def keep_records(self, changed: dict[str, str], before: int, items: int) -> None:
        """Writes new and changed records of a run that held ``before`` and now holds ``items``."""
        for identity, text in changed.items():
            self.records.updateValue((identity,), (text,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before_batch = self.totals.get()
        items, pages, stagnant, scroll, met = before_batch or (0, 0, 0, 0, False)
        held, paged = items, pages
        rows, batch = list(rows), []
        if rows:
            named = itemgetter(*[rows[0].__fields__.index(c) for c in STEP])
            batch = sorted((r for r in map(named, rows) if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1]))
        stored = self.stored_records(dict.fromkeys(r[4] for r in batch if r[4]), items)
        known: dict[str, dict] = {}  # records of this batch
        texts: dict[str, str] = {}
        lowered: dict[str, str] = {}
        merged_last: dict[str, str | None] = {}  # the same record twice in a row changes nothing
        bits: dict[int, int] = {}  # pages of this batch
        read: dict[int, int] = {}
        cleared = False
        last = None
        for seq, step in groupby(batch, key=itemgetter(0)):
            first, before = None, items
            for row in step:
                first = first or row
                _, _, _, _, identity, record, _, _, _, until = row
                if not identity:
                    continue
                if identity not in texts or merged_last[identity] != record:
                    merged_last[identity] = record
                    fields = json.loads(record) if record else {}
                    if identity not in texts and identity in stored:
                        known[identity] = json.loads(stored[identity])
                    merged = known.get(identity)
                    if merged is None:
                        known[identity], items = fields, items + 1
                    else:
                        merged.update({k: v for k, v in fields.items() if _present(v)})
                    texts[identity] = json.dumps(known[identity], ensure_ascii=False)
                    lowered[identity] = texts[identity].lower()
                if not met and until and until.strip().lower() in lowered[identity]:
                    met = True
            _, _, kind, number, _, _, min_items, target_pages, scroll_rounds, _ = first
            if kind == "filter":
                cleared, pages = True, 0
                bits.clear()
            elif kind == "collect":
                part, place = divmod(max(1, int(number)), PAGES)
                if part not in bits:
                    value = self.pages.getValue((part,)) if paged and not cleared else None
                    bits[part] = read[part] = int.from_bytes(value[0], "little") if value else 0
                if not bits[part] >> place & 1:
                    bits[part] |= 1 << place
                    pages += 1
            elif kind == "scroll":
                scroll = max(scroll, int(number))
                stagnant = stagnant + 1 if before > 0 and items <= before else 0
            enough = items >= int(min_items) and pages >= max(1, int(target_pages))
            done = (enough or met) and scroll >= int(scroll_rounds)
            last = (key[0], seq, items, pages, stagnant, scroll, met, done, STATE_VERSION)
        changed = {i: text for i, text in texts.items() if stored.get(i) != text}
        if changed:
            self.keep_records(changed, held, items)
        if cleared and paged:
            self.pages.clear()
        for part, seen in bits.items():
            if cleared or seen != read[part]:
                self.pages.updateValue((part,), (seen.to_bytes(PAGES // 8, "little"),))
        after = (items, pages, stagnant, scroll, met)
        if after != before_batch:
            self.totals.update(after)
        if last:
            yield Row(*columns_of(PROGRESS_OUT))(*last)

    def close(self) -> None:
        pass


def bucket_of(number: int, buckets: int) -> int:
    """Linear hashing: one more bucket takes rows of one other only."""
    size = 1 << (buckets - 1).bit_length()
    place = number & (size - 1)
    return place if place < buckets else place & (size // 2 - 1)


class BucketProgressProcessor(ProgressProcessor):
    """The same with about ``BUCKET`` records of a run in one value.

    A run has a bucket more for each ``BUCKET`` records, so a value stays small however many the run collects,
    and a batch asks the state store once for all its records in a bucket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("buckets", "bucket int", "records string")
        self.open(handle)

    def load(self, bucket: int) -> dict[str, str]:
        if bucket not in self.loaded:
            text = self.records.getValue((bucket,))
            self.loaded[bucket] = json.loads(text[0]) if text is not None else {}
        return self.loaded[bucket]

    def stored_records(self, identities: Iterable[str], items: int) -> dict[str, str]:
        self.loaded: dict[int, dict[str, str]] = {}
        if not items:
            return {}
        buckets = max(1, items // BUCKET)
        asked = {i: self.load(bucket_of(zlib.crc32(i.encode()), buckets)) for i in identities}
        return {i: held[i] for i, held in asked.items() if i in held}

    def keep_records(self, changed: dict[str, str], before: int, items: int) -> None:
        old, new = max(1, before // BUCKET), max(1, items // BUCKET)
        touched = {bucket_of(zlib.crc32(i.encode()), old) for i in changed} | {bucket_of(b, old) for b in range(old, new)}
        records: dict[str, str] = {}
        for bucket in touched if before else ():
            records |= self.load(bucket)
        placed: dict[int, dict[str, str]] = defaultdict(dict)
        for identity, text in (records | changed).items():
            placed[bucket_of(zlib.crc32(identity.encode()), new)][identity] = text
        for bucket in touched | placed.keys():
            if bucket in placed or self.loaded.get(bucket):
                self.records.updateValue((bucket,), (json.dumps(placed[bucket], ensure_ascii=False),))


def stream_progress(events: DataFrame) -> DataFrame:
    """Newest progress of every run after each micro-batch.

    ``events``: thread_id, seq, pos, kind (collect, scroll, filter), page_number, identity,
    record (JSON), min_items, target_pages, scroll_rounds, until_text.
    """
    return events.groupBy("thread_id").transformWithState(
        statefulProcessor=BucketProgressProcessor(), outputStructType=PROGRESS_OUT, outputMode="Update", timeMode="None"
    )


def restore_progress(states: DataFrame, version: int = STATE_VERSION, column: str = "state_version") -> DataFrame:
    """Stored progress to resume from; a state written by a newer version is refused."""
    seen = F.coalesce(column, F.lit(0))
    refuse: Column = F.raise_error(F.concat(F.lit("unsupported progress version "), seen.cast("string"), F.lit(f"; current={version}")))
    checked = F.when(seen <= version, seen).otherwise(refuse.cast("int"))
    return states.withColumn(column, checked)
