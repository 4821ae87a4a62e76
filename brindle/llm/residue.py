"""Template residue, filler and error pages in place of content, found by character n-gram models.

Models of hashed character 5- and 3-grams: natural prose, counted over the corpus's distinct sentences without
those that a first model marks, and unfilled placeholders, written-out prompts, filler of two kinds and error
notices, from labelled seeds and from what the first model marks without doubt. A position's score for a class
is the log likelihood ratio of the n-grams that end there, class against prose. Windows whose mean score is
high localise residue; what decides is a window itself for prompts, the marked share of a sentence for filler,
and that of the text for notices.

A second channel has the shape of the text: each run of words one letter, each number one digit, all else as
it is, so that the marks around a field stand side by side however long the field is. A placeholder is a
window of shape n-grams that are likelier around fields than in prose, where the letters between the marks
don't say the contrary.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm import seeds
from brindle.session import map_batches, stage

#: Orders of n-grams with their weights, of letters and of shapes; buckets of each order, and the share of probability for n-grams never seen.
ORDERS, SHAPE_ORDERS, BUCKETS, UNSEEN = {5: 0.6, 3: 0.4}, {4: 0.5, 3: 0.5}, 1 << 18, 0.1
ROWS = len(ORDERS) + len(SHAPE_ORDERS)
#: Share of the labelled natural texts in the prose model, and of what a first model marks in the class models.
NATURAL, LEARNT = 0.05, 0.3
#: Buckets of one block of counts in transport, and characters that are scored at once.
BLOCK, SPAN = 1024, 1 << 20
#: Digests of sentences that a task remembers, so that a repeated one moves once; beyond, it starts again.
SEEN = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """A class's window width in characters, the mean score that marks a window, and what decides.

    ``share`` of the characters must be marked: of the text, or with ``sentence`` characters given, of one
    sentence of at least that length (so a sentence that only mentions filler is none). Without a share one
    window is enough.
    """

    width: int
    mean: float
    share: float | None = None
    sentence: int | None = None
    label: str | None = None


@dataclass(frozen=True)
class ShapeRule:
    """A placeholder's windows: of so many shape n-grams, whose sum must be so high, and of the best ``width`` letters at or between the marks, taken with the mean of all that are there.

    Letters must speak for a field, and both together reach ``total``; shapes that ordinary writing doesn't have at all (``clear``) need no letters.
    """

    grams: int
    width: int
    least: float
    letters: float
    total: float
    clear: float


#: Texts shorter than this are no case.
LEAST = 5
PLACEHOLDER = ShapeRule(4, 6, 1.5, 0.0, 5.5, 17.0)
#: The least that a shape n-gram scores.
AGAINST = -0.5
#: Rules by model. Named stand-ins ("dummy text") have a model of their own, so that neither dilutes the other's shares, and are filler like nonsense Latin.
RULES = {
    "prompt": Rule(10, 2.2, label="placeholder"),
    "filler": Rule(16, 0.9, share=0.6, sentence=LEAST),
    "stand_in": Rule(16, 0.9, share=0.6, sentence=LEAST, label="filler"),
    "notice": Rule(16, 0.7, share=0.65),
}
LABELS = ("placeholder", "filler", "notice")
#: Sentences of which so much is marked by one class teach its model if they are so long, and are not prose. Nonsense shares its words with nothing else, so less of it is enough.
SURE, LONG = {"filler": 0.3, "stand_in": 0.7, "notice": 0.85}, 20

_SENTENCE = regex.compile(r"[^.!?。！？]+")
# A sentence with its end, or ends alone; and the digits that n-grams hold alike.
_WITH_END, _DIGIT = regex.compile(r"[^.!?。！？]+[.!?。！？ ]*|[.!?。！？ ]+"), regex.compile("[0-9]")
_BREAK = regex.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+")
# Mark-up that ends a line.
_TAG = regex.compile(r"</?(?:br|p|div|li|ul|ol|h[1-6]|tr|td|table|hr|blockquote)\b[^<>]{0,200}>")
# Labelled filler as whole sentences: short ones score too little in a window among other text.
_WHOLE = frozenset(" ".join(s.split()).strip(" .!?。") for s in (*seeds.FILLER, *(r for row in seeds.KEYS for r in (row, row[::-1]))))
# Finds texts that hold any of them, to be looked at by sentences.
_HOLDS = ahocorasick.Automaton()
for _w in _WHOLE:
    _HOLDS.add_word(_w, True)
_HOLDS.make_automaton()
#: Characters that the parts of a very long text have in common: more than a window or a short filler sentence.
OVERLAP = 2048


def normal(text: str) -> str:
    """Lower case, each run of white space one blank, none at the ends."""
    return " ".join(text.lower().split())


def lines(text: str) -> tuple[str, list[int]]:
    """A text as ``normal`` has it, and the places in it where a line ended."""
    parts = [n for n in map(normal, _BREAK.split(text)) if n]
    return " ".join(parts), list(itertools.accumulate(len(n) + 1 for n in parts[:-1]))


def _codes(text: str) -> np.ndarray:
    """A normalised text's characters, all digits alike."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes


def _shape_table() -> np.ndarray:
    """Of the characters of the first plane what they are in a shape: letters one letter, numbers one digit, blanks one blank, all else itself."""
    table = np.arange(1 << 16, dtype=np.uint64)
    kinds = {"L": 97, "M": 97, "N": 48, "Z": 32}
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))[0]
        if kind in kinds and c != 0x3007:
            table[c] = kinds[kind]
    return table


_SHAPES = _shape_table()


def shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shape of characters, and where each of its signs stands. Words with a blank between them are one run; numbers, too, are one sign."""
    t = np.where(codes < 1 << 16, _SHAPES[np.minimum(codes, 0xFFFF).astype(np.int64)], codes)
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | ((t[1:] != 97) & (t[1:] != 48))
    at = np.flatnonzero(first)
    t = t[at]
    if len(t) > 2:
        joint = np.zeros(len(t), bool)
        joint[1:-1] = (t[1:-1] == 32) & (t[:-2] == 97) & (t[2:] == 97)
        keep = ~joint
        keep[1:] &= ~joint[:-1]
        at, t = at[keep], t[keep]
    return t, at


#: Signs of a shape that are no marks.
_PLAIN = frozenset((10, 32, 48, 97))


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each n-gram, by its last character but for the first order - 1 ones."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(46)).astype(np.int64)


def _count(texts: list[str], into: np.ndarray, channels: tuple[bool, bool] = (True, True)) -> None:
    """Adds the n-grams of normalised texts, of letters and of shapes; texts are held apart by a line feed that normalising has left in none of them."""
    codes = _codes("\n".join(texts))
    parts = [(codes, ORDERS)] if channels[0] else []
    if channels[1]:
        parts.append((shapes(codes)[0], SHAPE_ORDERS))
    row = 0 if channels[0] else len(ORDERS)
    for signs, orders in parts:
        apart = signs == 10
        for order in orders:
            b = _grams(signs, order)
            if len(b):
                crossing = np.convolve(apart, np.ones(order), "valid") > 0
                into[row] += np.bincount(b[~crossing], minlength=BUCKETS)
            row += 1


#: What is counted: prose in both channels, then the letters of each class's sentences.
_COUNTED = ROWS + len(RULES) * len(ORDERS)


def _counter(known=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts texts, with what stands before them if a second column has it; with score tables in ``known``, texts that these mark count for their class if they are sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_COUNTED, BUCKETS), np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            leads = b.column(1).to_pylist() if b.num_columns > 1 else [""] * len(texts)
            found = classify(known.value, texts, by_model=True, sure=SURE) if known else [{}] * len(texts)
            held, size = [], 0
            sure: dict[str, list[str]] = {}
            for t, lead, f in zip(texts, leads, found, strict=True):
                if t and not f:
                    held.append(normal(lead + t))
                    size += len(t)
                elif t and len(t) >= LONG and len(f) == 1 and (one := next(iter(f.items())))[1] >= SURE.get(one[0], 2):
                    sure.setdefault(one[0], []).append(normal(t))
                if size > SPAN:
                    _count(held, total[:ROWS])
                    held, size = [], 0
            if held:
                _count(held, total[:ROWS])
            for name, own in sure.items():
                at = ROWS + list(RULES).index(name) * len(ORDERS)
                _count(own, total[at : at + len(ORDERS)], (True, False))
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blocks[used].tolist(), pa.list_(pa.int64()))], names=["block", "counts"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = counts.values.to_numpy(zero_copy_only=False)
            sums[k] = sums[k] + v if k in sums else v.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["block", "counts"])


def count_corpus(df: DataFrame, text: str, lead: str | None = None, known=None) -> np.ndarray:
    """n-gram counts, [row, bucket]: first those of prose, which are all texts or those that the broadcast tables ``known`` don't mark, then of each class's sure texts. Of fixed size whatever the corpus; each task sends at most that."""
    schema = "block int, counts array<long>"
    parts = map_batches(df.select(df[text].cast("string").alias("t"), *([df[lead]] if lead else [])), _counter(known), schema)
    rows = map_batches(parts.repartition("block"), _add_blocks, schema).collect()
    total = np.zeros((_COUNTED * BUCKETS // BLOCK, BLOCK), np.int64)
    for r in rows:
        total[r["block"]] = r["counts"]
    return total.reshape(_COUNTED, BUCKETS)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    back = max(ORDERS) - 1
    for b in batches:
        rows, size = [], 0
        for t in b.column(0).to_pylist():
            n = normal(t) if t else ""
            for m in _WITH_END.finditer(n):
                sentence = m[0].strip()
                h = blake2b(_DIGIT.sub("0", sentence).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if h not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    rows.append((h, n[max(0, m.start() - back) : m.start()], sentence))
                    size += len(sentence)
            if size > SPAN:
                yield _sentence_rows(rows)
                rows, size = [], 0
        if rows:
            yield _sentence_rows(rows)


def _sentence_rows(rows: list[tuple[bytes, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True)], names=["digest", "lead", "t"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, the first of each digest."""
    last = None
    for b in batches:
        rows = []
        for i, h in enumerate(b.column(0).to_pylist()):
            if h != last:
                rows.append(i)
                last = h
        if rows:
            part = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2)], names=["lead", "t"])


def distinct_sentences(df: DataFrame, text: str) -> DataFrame:
    """Each sentence of the normalised texts once, digits alike, as ``t``, with the characters before it as ``lead``. How often texts or sentences are copied makes no difference."""
    each = map_batches(df.select(df[text].cast("string").alias("t")), _split, "digest binary, lead string, t string")
    return map_batches(each.repartition("digest").sortWithinPartitions("digest", "lead", "t"), _firsts, "lead string, t string")


def prose_counts(df: DataFrame, text: str) -> np.ndarray:
    """n-gram counts of distinct sentences, without those that tables fitted on all distinct ones mark: repeated residue doesn't become prose."""
    once = stage(distinct_sentences(df, text), "sentences")
    first = df.sparkSession.sparkContext.broadcast(fit(count_corpus(once, "t", "lead")[:ROWS]))
    return count_corpus(once, "t", "lead", first)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@functools.cache
def _labelled() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """n-gram shares of the labelled natural texts, and of each class's: letters, and the shapes of placeholders among words."""
    n = len(ORDERS)
    natural = np.zeros((ROWS, BUCKETS), np.int64)
    _count([normal(s) for s in seeds.natural()], natural)
    own = {}
    for name, make in seeds.CLASSES.items():
        texts = make()
        counts = np.zeros((ROWS, BUCKETS), np.int64)
        _count([normal(s) for s in texts], counts[:n], (True, False))
        if name == "placeholder":
            _count([normal(s) for s in seeds.in_context(texts)], counts, (False, True))
        own[name] = _shares(counts)
    return _shares(natural), own


def fit(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Score tables [row, bucket] of each class: weighted log ratios of its n-gram shares to those of prose. ``counts``: those of prose, or all that ``count_corpus`` gives."""
    weights = np.array([*ORDERS.values(), *SHAPE_ORDERS.values()])[:, None]
    log = lambda share: np.log((1 - UNSEEN) * share + UNSEEN / BUCKETS)
    natural, labelled = _labelled()
    base = log((1 - NATURAL) * _shares(counts[:ROWS]) + NATURAL * natural if counts[:ROWS].any() else natural)
    n = len(ORDERS)
    tables = {}
    for name, own in labelled.items():
        share = own[:n]
        if name in RULES and len(counts) > ROWS:
            at = ROWS + list(RULES).index(name) * n
            learnt = counts[at : at + n]
            if learnt.any():
                share = (1 - LEARNT) * share + LEARNT * _shares(learnt)
        tables[name] = (weights[:n] * (log(share) - base[:n])).astype(np.float32)
        if name == "placeholder":
            # what stands around marks says little against them
            tables["shape"] = np.maximum(weights[n:] * (log(own[n:]) - base[n:]), AGAINST).astype(np.float32)
    return tables


def _scores(table: np.ndarray, orders: dict[int, float], grams: list[np.ndarray], n: int) -> np.ndarray:
    """Each sign's score by the n-grams that end there; bucket ``BUCKETS`` stands for those that begin in another text."""
    score = np.zeros(n, np.float32)
    for i, order in enumerate(orders):
        if len(grams[i]):
            score[order - 1 :] += np.append(table[i], np.float32(0))[grams[i]]
    return score


def windows(tables: dict[str, np.ndarray], texts: list[str]) -> dict[str, list[np.ndarray]]:
    """Of each model, which characters of each normalised text lie in a window that is marked; ``placeholder`` by shapes and letters together."""
    marked, bounds = _windows(tables, texts)
    return {name: [mask[a:b] for a, b in bounds] for name, mask in marked.items()}


def _windows(tables: dict[str, np.ndarray], texts: list[str]) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """``windows`` of all texts in one row, and where each text is in it."""
    # line feeds before each text, which are in none, hold them apart: so many that no window of shapes has signs of two
    gap = PLACEHOLDER.grams
    codes = _codes("".join("\n" * gap + t for t in texts) + "\n" * gap)
    size = np.array([len(t) + gap for t in texts] + [gap], np.int64)
    end = np.cumsum(size)
    place = np.arange(len(codes)) - np.repeat(end - size, size) - gap
    rest = np.repeat(size - gap, size) - np.maximum(place, 0)  # characters from here to the text's end
    grams = []
    for order in ORDERS:
        b = _grams(codes, order)
        b[place[order - 1 :] < order - 1] = BUCKETS
        grams.append(b)
    marked = {}
    for name, rule in RULES.items():
        sums = np.concatenate([[0], np.cumsum(_scores(tables[name], ORDERS, grams, len(codes)), dtype=np.float64)])
        w = np.minimum(rule.width, np.repeat(size - gap, size))
        # a text shorter than the window must say as much as a longer one in its fewer characters
        at = np.flatnonzero((rest >= w) & (place >= 0))
        at = at[sums[at + w[at]] - sums[at] >= rule.mean * rule.width]
        edge = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + w[at], minlength=len(codes) + 1)
        marked[name] = np.cumsum(edge[:-1]) > 0
    letters = _scores(tables["placeholder"], ORDERS, grams, len(codes))
    marked["placeholder"] = _placeholders(tables["shape"], codes, letters, place)
    first = (end - size + gap).tolist()
    return marked, list(zip(first[:-1], end[:-1].tolist(), strict=True))


def _placeholders(table: np.ndarray, codes: np.ndarray, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which characters lie in a window of shapes that is marked."""
    signs, at = shapes(codes)
    score = np.zeros(len(signs), np.float32)
    apart = np.flatnonzero(signs == 10)
    since = np.arange(len(signs)) - np.repeat(apart, np.diff(np.append(apart, len(signs)))) if len(apart) else np.arange(len(signs))
    for i, order in enumerate(SHAPE_ORDERS):
        b = _grams(signs, order)
        if len(b):
            score[order - 1 :] += np.where(since[order - 1 :] >= order - 1, table[i][b], 0)
    mask = np.zeros(len(codes), bool)
    r = PLACEHOLDER
    sums = np.concatenate([[0], np.cumsum(score, dtype=np.float64)])
    letter_sums = np.concatenate([[0], np.cumsum(letters, dtype=np.float64)])
    back = max(SHAPE_ORDERS) - 1
    k = min(r.grams, len(signs))
    for i in np.flatnonzero(sums[k:] - sums[:-k] >= r.least):
        last = next((j for j in range(i + k - 1, i - 1, -1) if since[j]), None)
        if last is None:
            continue
        # with the signs before that its first n-gram has, but for those of another text
        first = max(i - back, last - int(since[last]) + 1)
        lo, hi = int(at[first]), int(at[last + 1]) if last + 1 < len(at) else len(codes)
        # letters count from the first mark to the last one, or on to where words end that nothing closes
        marks = [j for j in range(first, last + 1) if signs[j] not in _PLAIN]
        if not marks:
            continue
        lo = max(lo, int(at[marks[0]]) - 1)
        if len(marks) > 1:
            hi = min(hi, int(at[marks[-1]]) + 2)
        starts = np.arange(max(lo - 2, lo - max(0, int(place[lo]))), max(lo + 1, hi - r.width + 1))
        best = (letter_sums[np.minimum(starts + r.width, hi)] - letter_sums[starts]).max()
        # what the best letters say, and all of them
        best = (best + (letter_sums[hi] - letter_sums[lo]) * r.width / max(hi - lo, r.width)) / 2
        shape = sums[i + k] - sums[i]
        if shape >= r.clear or (best >= r.letters and shape + best >= r.total):
            mask[lo:hi] = True
    return mask


def _sentences(text: str, breaks: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Where sentences begin and end, without blanks around: at full stops, ends of lines and mark-up."""
    cuts = sorted({0, len(text), *breaks, *(p for m in _TAG.finditer(text) for p in m.span())})
    for lo, hi in itertools.pairwise(cuts):
        if _TAG.fullmatch(text, lo, hi):
            continue
        for m in _SENTENCE.finditer(text, lo, hi):
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            b = m.start() + len(m[0].rstrip())
            if a < b:
                yield a, b


def judge(text: str, marked: dict[str, np.ndarray], breaks: Iterable[int] = ()) -> dict[str, float]:
    """Each model that applies to a normalised text with lines ending at ``breaks``, with the share of its characters that windows mark."""
    found = {}
    for name, mask in marked.items():
        count = int(np.count_nonzero(mask))
        if not count:
            continue
        rule = RULES.get(name)
        if rule is None or rule.share is None:
            ok = True
        elif rule.sentence is None:
            ok = count >= rule.share * len(mask)
        else:
            ok = any(b - a >= rule.sentence and np.count_nonzero(mask[a:b]) >= rule.share * (b - a) for a, b in _sentences(text, breaks))
        if ok:
            found[name] = count / len(mask)
    return found


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """A text in parts of at most ``SPAN`` characters with their first places, cut between sentences where one ends in the part's last eighth. Each part but the first begins ``OVERLAP`` characters early."""
    lo = 0
    while len(text) - lo > SPAN:
        cut = max(text.rfind(end, lo + SPAN - SPAN // 8, lo + SPAN) for end in (". ", "! ", "? ", "。"))
        hi = cut + 1 if cut >= 0 else lo + SPAN
        yield lo, text[lo:hi]
        lo = hi - min(OVERLAP, (hi - lo) // 2)
    yield lo, text[lo:]


def classify(tables: dict[str, np.ndarray], texts: list[str | None], *, by_model: bool = False, sure: dict[str, float] | None = None) -> list[dict[str, float]]:
    """The classes of each text with their coverage, or the models that mark it; nothing for null, empty and very short ones. Texts are taken in parts of ``SPAN`` characters.

    With ``sure`` a model applies already where it marks its share of the text that is given there.
    """
    found: list[dict[str, float]] = [{} for _ in texts]
    pieces: list[tuple[int, int, str, list[int]]] = []
    notice: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(texts):
        n, breaks = lines(t) if t else ("", [])
        if len(n.strip()) >= LEAST:
            done = 0
            for at, part in _parts(n):
                pieces.append((i, done - at, part, [x - at for x in breaks if at < x < at + len(part)] if breaks else []))
                done = at + len(part)
    lo = 0
    while lo < len(pieces):
        hi, room = lo, SPAN
        while hi < len(pieces) and (room > 0 or hi == lo):
            room -= len(pieces[hi][2])
            hi += 1
        part = [p[2] for p in pieces[lo:hi]]
        marked, bounds = _windows(tables, part)
        some = np.add.reduceat(np.logical_or.reduce(list(marked.values())), [a for a, _ in bounds]) > 0
        for k, t in enumerate(part):
            i, seen, _, breaks = pieces[lo + k]
            whole = next(_HOLDS.iter(t), None) is not None
            if not some[k] and not whole:
                notice.setdefault(i, []).append((len(t) - seen, 0))
                continue
            own = {c: m[bounds[k][0] : bounds[k][1]] for c, m in marked.items()}
            for a, b in _sentences(t, breaks) if whole else ():
                if t[a:b] in _WHOLE:
                    own["filler"][a:b] = True
            notice.setdefault(i, []).append((len(t) - seen, int(np.count_nonzero(own["notice"][seen:]))))
            if any(m.any() for m in own.values()):
                for c, share in judge(t, own, breaks).items():
                    found[i][c] = max(share, found[i].get(c, 0))
                for c, least in (sure or {}).items():
                    if (share := np.count_nonzero(own[c]) / len(t)) >= least:
                        found[i][c] = max(share, found[i].get(c, 0))
        lo = hi
    for i, parts in notice.items():
        if len(parts) > 1:
            # in parts it is the whole text's share that counts
            n, marks = (sum(x) for x in zip(*parts, strict=True))
            found[i].pop("notice", None)
            if marks >= RULES["notice"].share * n:
                found[i]["notice"] = marks / n
    if by_model:
        return found
    out: list[dict[str, float]] = []
    for f in found:
        labels: dict[str, float] = {}
        for name, share in f.items():
            label = RULES[name].label or name if name in RULES else name
            labels[label] = max(share, labels.get(label, 0))
        out.append(labels)
    return out


def _detect(tables, keep: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = classify(tables.value, b.column(keep).to_pylist())
            rows = [i for i, f in enumerate(found) if f]
            if rows:
                part = b.take(pa.array(rows))
                cols = [part.column(i) for i in range(keep)]
                cols += [pa.array([found[i].get(c) for i in rows], pa.float64()) for c in LABELS]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def find_residue(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The rows whose text is or holds residue: the ``keep`` columns and the share of characters marked as placeholder, filler and notice, null where the class doesn't apply.

    The prose model is counted over the distinct sentences of ``df`` that a first model doesn't mark, and every
    text is judged whole. Null and empty texts
    and those of fewer than five characters are no case. Repeated rows each give a row; an empty table gives
    none. Keep columns named like a class are a ValueError; other columns don't matter. Only tables of fixed
    size (12 MB) come to the driver and are broadcast.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if {*keep} & {*LABELS}:
        raise ValueError(f"kept columns are named like classes: {sorted({*keep} & {*LABELS})}")
    tables = df.sparkSession.sparkContext.broadcast(fit(prose_counts(df, text)))
    out = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(c, T.DoubleType()) for c in LABELS]])
    return map_batches(df.select(*keep, df[text].cast("string").alias("__text")), _detect(tables, len(keep), to_arrow_schema(out)), out)


def without_residue(df: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` without the rows that ``find_residue`` finds, by a key that is unique and not null."""
    return df.join(find_residue(df, text, [key]).select(key), key, "left_anti")
