"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a sentence)
and units turn into typed placeholders, other words lose their case and the
punctuation at their ends. Names in a row are one placeholder, so a new name may have
another number of words. Windows of ``size`` template tokens of every benchmark item
are hashed; a document's windows are joined with them by hash. A hit is verified token
by token. Hits that follow one another in item and document form a chain: words may be
put in, left out or changed between them, up to half the item's words or ``size``. The
slots of a chain must be consistent: one value of the item always meets one value of
the document, which other values may meet too. The windows that hold a value of which
this is not so are dropped, at all its places; the others count. So a question with
other numbers or names is still caught, while a passage that merely has the same shape
is not.

Every text also has a folded form: names are words like others there, without case, so
a copy in lower case or capitals or with other sentence ends is found by it. Hits of
either form count, each with its own windows. A name of the item that meets another
name between two parts of a folded chain is a slot as it is in the typed form.

A document is contaminated by an item when the windows left of one chain are at least
``share`` of the item's windows, or when RUN template words in a row agree, ``size`` of
them literally; where windows were dropped, twice ``size`` words in a row. Items of fewer than ``3 * size - 1`` words have windows of
a third of their words, LEAST at least, so that one changed word leaves half of them;
below ``3 * LEAST - 1`` words it is ``size`` again, and an item with fewer words than
that has one window, its whole template. Windows made of placeholders only say nothing
and are left out.

The benchmark's windows are broadcast while they number at most ``broadcast_windows``
(24 bytes each and the items' texts); beyond that the windows of both sides are joined
by a shuffle on the hash, and only the documents with hits are verified.

Null, empty or wordless text on either side: no windows, never contaminated. Repeated
documents are judged alike; repeated items count as separate items. Item ids are numbers
or strings; an item without an id counts like others and is a null, last, among a
document's items. Empty tables: an empty result, or no document contaminated.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from docloom.llm import textkit
from docloom.llm.textkit import U64

#: Template tokens in a window.
SIZE = 8
#: Fewest template tokens in a window of an item longer than that.
LEAST = 5
#: Template words in a row that contaminate, whatever the item's length.
RUN = 13
#: Windows up to which the benchmark is broadcast: at most 48 MB with their places.
BROADCAST_WINDOWS = 2_000_000

# Unit words that become a placeholder.
UNITS = """
mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
ml l liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours day days week weeks month months year years
kb mb gb tb byte bytes usd eur gbp dollar dollars euro euros cent cents percent % $ degree degrees
""".split()

_NUMBER = re.compile(r"[+\-$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"[+\-$]?\d[\d.,]*([a-z%]+)")
_ENDS = ".!?:"
_STRIP = "\"'()[]{}<>,;.!?:*_~`«»“”‘’¿¡#&|"

NUM, NAME, UNIT = "\x01num", "\x01name", "\x01unit"
_UNITS = frozenset(UNITS)
_STEP = U64(0xC2B2AE3D27D4EB4F)


def token(word: str, starts_sentence: bool) -> str:
    """The template token of a word."""
    bare = word.strip(_STRIP)
    low = bare.lower()
    if not bare:
        return ""
    if _NUMBER.fullmatch(low):
        return NUM
    found = _NUMBER_UNIT.fullmatch(low)
    if found and found[1] in _UNITS:
        return NUM
    if low in _UNITS and len(low) > 1 or bare in ("%", "$"):
        return UNIT
    if not starts_sentence and bare[:1].isupper() and not bare.isupper():
        return NAME
    return low


def ends_sentence(word: str) -> bool:
    return word.rstrip("\"')]*»”’").endswith(tuple(_ENDS))


class Form(NamedTuple):
    """A text as template tokens with the words' bare values, and which of them are names."""

    tokens: list[str]
    values: list[str]
    names: list[bool]


def folded(token: str) -> str:
    """The token of a word that is no name, without case."""
    return token.casefold()


def template(text: str | None) -> tuple[Form, Form]:
    """The typed form of a text, and the folded one, in which names are words like others.

    A line break starts a sentence. In the typed form a run of names is one slot.
    """
    typed, plain = Form([], [], []), Form([], [], [])
    for line in (text or "").split("\n"):
        fresh = True
        for raw in line.encode("utf-8", "replace").split():
            word = raw.decode("utf-8", "replace")
            t = token(word, fresh)
            fresh = ends_sentence(word)
            if not t:
                continue
            value = word.strip(_STRIP).casefold()
            name = t == NAME
            for part, x in zip(plain, (folded(token(word, True)), value, name)):
                part.append(x)
            if name and typed.tokens and typed.names[-1]:
                typed.values[-1] += " " + value
            else:
                for part, x in zip(typed, (t, value, name)):
                    part.append(x)
    return typed, plain


def window_width(n: int, size: int) -> int:
    """Tokens in the windows of an item of ``n``: one changed word must spare half of a short item's."""
    third = (n + 1) // 3
    return min(size, n, third if third >= LEAST else n)


class Part(NamedTuple):
    """Windows of an item, at ``places``, that meet a document ``shift`` tokens further on without a gap."""

    start: int
    end: int
    shift: int
    places: list[int]


def parts(by_shift: dict[int, list[int]], width: int) -> list[Part]:
    """The maximal parts of the hits; places ascend."""
    out: list[Part] = []
    for shift, places in by_shift.items():
        cut = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] > places[i - 1] + width:
                out.append(Part(places[cut], places[i - 1] + width, shift, places[cut:i]))
                cut = i
    return out


def chains(found: list[Part], n: int, reach: int) -> Iterator[list[Part]]:
    """Parts that follow one another in item and document with shifts at most ``reach`` apart.

    Every part is in one chain; those of the most words come first.
    """
    found = sorted(found, key=lambda p: (p.start + p.shift, p.start))
    score = [p.end - p.start for p in found]
    back = [-1] * len(found)
    low = 0
    for i, p in enumerate(found):
        while found[low].start + found[low].shift + n + reach < p.start + p.shift:
            low += 1
        for j in range(low, i):
            q = found[j]
            if abs(p.shift - q.shift) > reach or p.start < q.start:
                continue
            more = p.end - max(p.start, q.end, q.end + q.shift - p.shift)
            if more > 0 and score[j] + more > score[i] and back[i] != j:
                score[i], back[i] = score[j] + more, j
    used = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain: list[Part] = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            yield _disjoint(chain[::-1])


def _disjoint(chain: list[Part]) -> list[Part]:
    """The chain without windows on words of the document that the part before has."""
    out, stop = [], -1
    for p in chain:
        places = [x for x in p.places if x + p.shift >= stop]
        if places:
            out.append(Part(places[0], p.end, p.shift, places))
            stop = p.end + p.shift
    return out


class Items:
    """Benchmark items with their window hashes."""

    def __init__(self, items: list[tuple[int, str | None]], size: int, share: float):
        self.size, self.share = size, share
        self.ids = [i for i, _ in items]
        self.forms = [template(t) for _, t in items]
        self.widths = [[window_width(len(form.tokens), size) for form in both] for both in self.forms]
        self.windows = [[0, 0] for _ in items]
        self.by_hash: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        every: dict[int, set[int]] = defaultdict(set)
        for k, both in enumerate(self.forms):
            for f, form in enumerate(both):
                width = self.widths[k][f]
                for at, h in enumerate(window_hashes(form.tokens, width).tolist()):
                    if any(t[0] != "\x01" for t in form.tokens[at : at + width]):
                        self.by_hash[h].append((k, f, at))
                        every[width].add(h)
                        self.windows[k][f] += 1
        self.sorted = {w: np.array(sorted(h), U64) for w, h in sorted(every.items())}

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(item id, covered share of its windows) of the items that contaminate the text."""
        both = template(text)
        found: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for f, own in enumerate(both):
            for width, wanted in self.sorted.items():
                h = window_hashes(own.tokens, width)
                near = np.flatnonzero(np.isin(h, wanted))
                for at, key in zip(near.tolist(), h[near].tolist()):
                    for k, form, place in self.by_hash[key]:
                        if form == f and self.widths[k][f] == width and self.forms[k][f].tokens[place : place + width] == own.tokens[at : at + width]:
                            found[k, f][at - place].append(place)
        best: dict[int, float] = {}
        for (k, f), by_shift in found.items():
            n = len(self.forms[k][f].tokens)
            for chain in chains(parts(by_shift, self.widths[k][f]), n, max(self.size, n // 2)):
                shifts = {p.shift for p in chain}
                alone = [[p for p in chain if p.shift == s] for s in shifts] if len(shifts) > 1 else []
                for some in (chain, *alone):
                    share = self._judged(k, f, both[f], some)
                    if share is not None:
                        best[k] = max(best.get(k, 0.0), share)
        return sorted(((self.ids[k], s) for k, s in best.items()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))

    def _judged(self, k: int, f: int, own: Form, chain: list[Part]) -> float | None:
        """The share of the item's windows in the chain, if that contaminates."""
        item, width = self.forms[k][f], self.widths[k][f]
        met: dict[str, set[str]] = defaultdict(set)
        slots: list[tuple[int, str]] = []
        for p in chain:
            slots += [(x, own.values[x + p.shift]) for x in range(p.start, p.end) if item.names[x] or item.tokens[x][0] == "\x01"]
        for p, q in zip(chain, chain[1:]):  # names of the folded form that differ lie between its parts
            if f and p.shift == q.shift:
                slots += [(x, own.values[x + p.shift]) for x in range(p.end, q.start) if item.names[x] and own.names[x + p.shift]]
        key = lambda x: (NAME if item.names[x] else item.tokens[x]) + item.values[x]
        for x, value in slots:
            met[key(x)].add(value)
        bad = {x for x, _ in slots if len(met[key(x)]) > 1}
        kept = [Part(p.start, p.end, p.shift, [x for x in p.places if not bad.intersection(range(x, x + width))]) for p in chain] if bad else chain
        share = len({x for p in kept for x in p.places}) / self.windows[k][f]
        least = max(RUN, 2 * self.size) if bad else RUN
        if share >= self.share or any(self._tells(item, own, p, least) for p in parts(_by_shift(kept), width)):
            return share
        return None

    def _tells(self, item: Form, own: Form, p: Part, least: int) -> bool:
        """Whether a part has ``least`` words, ``size`` of them more than a slot of another value."""
        return p.end - p.start >= least and sum(item.tokens[x][0] != "\x01" or item.values[x] == own.values[x + p.shift] for x in range(p.start, p.end)) >= self.size


def _by_shift(chain: list[Part]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = defaultdict(list)
    for p in chain:
        out[p.shift] += p.places
    return out


#: Of template hashes, which only choose what is compared: every hit is verified on its tokens.
SEED = 10


def token_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of template tokens, all in one pass."""
    return textkit.hash_all([t.encode("utf-8", "replace") for t in tokens], SEED)


def _windows(h: np.ndarray, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of all windows) for ascending widths, each made from the one before."""
    out, done = np.zeros(len(h), U64), 0
    for width in widths:
        for k in range(done, min(width, len(h) + 1)):
            out = out[: len(h) - k] * _STEP + h[k:]
        done = width
        yield width, out if width <= len(h) else out[:0]


def window_hashes(tokens: list[str], size: int) -> np.ndarray:
    """The hashes of the windows of these tokens."""
    if size == 0 or len(tokens) < size:
        return np.zeros(0, U64)
    return next(_windows(token_hashes(tokens), [size]))[1]


class Wanted:
    """Window hashes of one width; a table of their first bits answers most probes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = U64(64 - min(24, max(16, len(hashes).bit_length() + 5)))
        self.table = np.zeros(1 << 64 - int(self.shift), bool)
        self.table[(hashes >> self.shift).astype(np.int64)] = True

    def at(self, h: np.ndarray) -> np.ndarray:
        """Where the hashes are wanted."""
        near = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        return near[self.hashes[place] == h[near]]


#: What a word's template token is: its hash at a sentence's start, inside and folded, and whether it ends one.
_INFO_BITS = 20


class _TokenCache:
    """Template hashes by word, so that a word is canonicalised once a worker."""

    def __init__(self):
        self.table = textkit.UnitTable(_INFO_BITS)
        self.first = np.zeros(1 << _INFO_BITS - 1, U64)
        self.inner = np.zeros(1 << _INFO_BITS - 1, U64)
        self.folded = np.zeros(1 << _INFO_BITS - 1, U64)
        self.flags = np.zeros(1 << _INFO_BITS - 1, np.uint8)
        self.n = 0

    def rows(self, texts: textkit.Texts, w: textkit.Spans) -> np.ndarray:
        if self.table.full() or self.n > len(self.first) // 2:
            self.table.clear()
            self.n = 0
        return self.table.rows(texts, w.start, w.end, self._learn)

    def _learn(self, names: list[bytes]) -> np.ndarray:
        if self.n + len(names) > len(self.first):  # more new words in one slice than the cache holds
            grow = self.n + len(names)
            self.first, self.inner, self.folded, self.flags = (np.concatenate((x, np.zeros(grow - len(x), x.dtype))) for x in (self.first, self.inner, self.folded, self.flags))
        seen = [x.decode("utf-8", "replace") for x in names]
        inner = [token(word, False) for word in seen]
        opening = [token(word, True) if t == NAME else t for word, t in zip(seen, inner)]
        part = slice(self.n, self.n + len(names))
        self.first[part] = token_hashes(opening)
        self.inner[part] = token_hashes(inner)
        self.folded[part] = token_hashes([folded(t) for t in opening])
        self.flags[part] = [(not t) | 2 * ends_sentence(word) for word, t in zip(seen, inner)]
        self.n = part.stop
        return np.arange(part.start, part.stop)


_cache: list[_TokenCache] = []
_NAME_HASH = token_hashes([NAME])[0]


def suspects(texts: textkit.Texts, wanted: dict[int, Wanted]) -> np.ndarray:
    """Which texts share a window hash with the benchmark."""
    if not _cache:
        _cache.append(_TokenCache())
    w = textkit.words(texts)
    out = np.zeros(len(texts), bool)
    if not len(w.start):
        return out
    info = _cache[0]
    at = info.rows(texts, w)
    flags = info.flags[at]
    fresh = np.ones(len(at), bool)
    breaks = np.cumsum(texts.data == 0x0A)
    line = np.concatenate(([0], breaks))[w.start]
    fresh[1:] = (w.doc[1:] != w.doc[:-1]) | (line[1:] != line[:-1]) | ((flags[:-1] & 2) > 0)
    token_hash = np.where(fresh, info.first[at], info.inner[at])
    real = (flags & 1) == 0
    doc = w.doc[real]
    typed = token_hash[real]
    again = typed == _NAME_HASH  # a name after a name: one slot
    again[1:] &= again[:-1] & (doc[1:] == doc[:-1])
    again[:1] = False
    for own, h in ((doc[~again], typed[~again]), (doc, info.folded[at[real]])):
        for width, win in _windows(h, wanted):
            hit = wanted[width].at(win)
            out[own[hit[own[hit] == own[hit + width - 1]]]] = True
    return out


JUDGED = ("items", "covered", "contaminated")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    share: float = 0.5,
    broadcast_windows: int = BROADCAST_WINDOWS,
    keep_text: bool = False,
) -> DataFrame:
    """(id, items array, covered double, contaminated boolean) of every row.

    ``items`` are the ids of the contaminating items in order, ``covered`` the largest
    share of an item's windows. With ``keep_text`` whole rows are passed on instead of ids;
    their own columns with the name of one of these are then called ``_own_<name>``.
    """
    if not keep_text:
        docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        return decontaminate(docs, benchmark, "_id", "_text", item_col, item_text_col, size, share, broadcast_windows, True).select(F.col("_id").alias(id_col), *JUDGED)
    clash = [c for c in JUDGED if c in docs.columns]
    docs = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    id_col, text_col = (f"_own_{c}" if c in clash else c for c in (id_col, text_col))
    kind = "long" if isinstance(benchmark.schema[item_col].dataType, IntegralType) else "string"
    items = benchmark.select(F.col(item_col).cast(kind).alias("name"), F.col(item_text_col).alias("text"))
    # No form of an item has more windows than words, nor more words than half its characters and one.
    bound = 2 * items.agg(F.coalesce(F.sum((F.length("text") / 2).cast("long") + 1), F.lit(0))).first()[0]
    if bound > broadcast_windows:
        return _decontaminate_shuffled(docs, items, id_col, text_col, size, share, keep_text, kind)
    sent = docs.sparkSession.sparkContext.broadcast([(r["name"], r["text"]) for r in items.orderBy(F.col("name").asc_nulls_last()).collect()])
    return _judged(docs, lambda: Items(sent.value, size, share), id_col, text_col, keep_text, kind)


def decontamination_filter(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows that no item contaminates, with their own columns only."""
    judged = decontaminate(docs, benchmark, text_col=text_col, keep_text=True, **settings).filter(~F.col("contaminated"))
    return judged.select(*[F.col(f"`_own_{c}`" if c in JUDGED else f"`{c}`").alias(c) for c in docs.columns])


def _judged(docs: DataFrame, load, id_col: str, text_col: str, keep_text: bool, kind: str) -> DataFrame:
    carried = docs if keep_text else docs.select(id_col, text_col)
    names = carried.columns
    passed = [i for i, c in enumerate(names) if keep_text or c == id_col]
    schema = ", ".join(f"`{names[i]}` {carried.schema[i].dataType.simpleString()}" for i in passed) + f", items array<{kind}>, covered double, contaminated boolean"
    named = pa.list_(pa.int64() if kind == "long" else pa.string())
    text_at = names.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = load()
        wanted = {width: Wanted(h) for width, h in items.sorted.items()}
        for batch in batches:
            for row, texts in textkit.slices(batch.column(text_at)):
                found: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(suspects(texts, wanted)).tolist():
                    found[i] = items.matches(texts.cut(int(texts.offsets[i]), int(texts.offsets[i + 1])).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(row, len(texts)) for i in passed]
                    + [
                        pa.array([[i for i, _ in f] for f in found], named),
                        pa.array([max((s for _, s in f), default=0.0) for f in found], pa.float64()),
                        pa.array([bool(f) for f in found], pa.bool_()),
                    ],
                    names=[names[i] for i in passed] + ["items", "covered", "contaminated"],
                )

    return carried.mapInArrow(judge, schema)


def _item_parts(items: DataFrame, size: int) -> DataFrame:
    """(h, item) of every window of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                cut = Items([(item, text)], size, 1.0).sorted
                h = np.concatenate([np.zeros(0, U64), *cut.values()]).view(np.int64)
                width = np.repeat(np.array(list(cut), np.int32), [len(x) for x in cut.values()])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([item] * len(h), pa.int64()), pa.array(width, pa.int32())], names=["h", "item", "width"])

    return items.mapInArrow(cut, "h long, item long, width int")


def _decontaminate_shuffled(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, size: int, share: float, keep_text: bool, kind: str) -> DataFrame:
    """The same for a benchmark of any size: both sides' windows meet by hash.

    Rows get a number of their own; (number, item) candidates are verified with both
    texts at hand, item by item, so no task holds the benchmark.
    """
    from docloom.llm.store import Workspace

    ws = Workspace(docs.sparkSession, "decontamination")
    numbered = ws.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = ws.save(items.withColumn("item", F.monotonically_increasing_id()), "items")
    items = named.select("item", "text")
    windows = ws.save(_item_parts(items, size), "windows")
    widths = [r[0] for r in windows.select("width").distinct().collect()]  # at most ``size`` numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.unique(np.concatenate([window_hashes(form.tokens, k) for form in template(text) for k in widths])) if widths else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([number] * len(h), pa.int64())], names=["h", "_row"])

    own = numbered.select("_row", text_col).mapInArrow(cut, "h long, _row long")
    pairs = own.join(windows.select("h", "item").distinct(), "h").select("_row", "item").distinct()
    both = pairs.join(items, "item").withColumnRenamed("text", "_item_text").join(numbered.select("_row", F.col(text_col).alias("_text")), "_row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, item, item_text, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "item", "_item_text", "_text"))):
                out += [(number, i, s) for i, s in Items([(item, item_text)], size, share).matches(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["_row", "item", "s"])

    found = both.mapInArrow(verify, "_row long, item long, s double").join(named.select("item", F.struct(F.col("name").isNull().alias("none"), "name").alias("n")), "item")
    hits = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["name"]).alias("items"), F.max("s").alias("covered"))
    kept = docs.columns if keep_text else [id_col]
    return numbered.join(hits, "_row", "left").select(
        *kept, F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered"), F.col("items").isNotNull().alias("contaminated")
    )
