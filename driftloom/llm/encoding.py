"""Texts decoded with the wrong character encoding, found and restored.

Candidates for a garbled stretch come from its bytes: its characters are mapped
back to the bytes of a legacy encoding, an automaton over bytes finds the maximal
well-formed multibyte spans among them (UTF-8, EUC, Shift-JIS), and those spans
only are decoded; stretches garbled twice go through it again. Bytes of a
single-byte encoding have no such structure; there every byte is decoded, which
is a way of its own (``bytes``, as opposed to ``spans``), told apart in the result.

Well-formedness alone mistakes some sound words for garbled ones and says
nothing about single bytes. So each candidate is weighed by how usual it is: the
number of distinct texts of the whole corpus that hold each of its character pairs,
against the same of the stretch as it stands. The counts are kept in a hashed
table of fixed size, the only thing that is sent to all tasks.

A replacement character stands for lost bytes: such a text is found, and what is
left is restored. A stretch next to its own correct form (as in a table of wrong
and right spellings) is quoted, not garbled.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ways to find a text: well-formed multibyte spans, all bytes of one single-byte encoding read as another, lost bytes.
WAYS = ("spans", "bytes", "lost")

# Python's names of the encodings considered.
SINGLE_BYTE = (
    "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-1", "iso8859-2", "iso8859-5", "iso8859-7",
    "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman",
)
MULTI_BYTE = ("cp932", "gbk", "big5", "euc-kr", "euc-jp")

#: Automata over bytes: maximal runs of well-formed multibyte characters.
UTF8_RUN = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
EUC_RUN = re.compile(rb"(?:[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf]){2,}")
SJIS_RUN = re.compile(rb"(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]){2,}")
HIGH = re.compile(rb"[\x80-\xff]+")
RUNS = {"euc-jp": EUC_RUN, "gbk": EUC_RUN, "cp932": SJIS_RUN}

BITS = 20
SPACES = re.compile(r"[ \t\r\n]+")
ONE_DIGIT = dict.fromkeys(range(48, 58), 48)
CONTROLS = re.compile("[\x80-\x9f]")
ASCII = re.compile(r"[\x00-\x7f]")
WIDE = re.compile(r"[^\x00-\x7f]")
ADJACENT = re.compile(r"[^\x00-\x7f]{2}")
EASTERN = re.compile("[\u2e80-\uffff]")
LOST = "�"
#: A lone replacement character in quotes is spoken of, not suffered.
QUOTE_MARKS_ONLY = "“”„\"‘’'«»`"
SPOKEN_OF = re.compile(f"[{QUOTE_MARKS_ONLY}]{LOST}+[{QUOTE_MARKS_ONLY}]")
QUOTE_MARKS = "“”„‘’«»\"'.,;:!?()[]"
#: Mean gain in log document frequency per character pair that a candidate needs.
LEAST_GAIN_SPAN = 0.4
LEAST_GAIN_BYTES = 2.0
#: The gain over the changed pairs alone must be higher by this.
LOCAL_EXTRA = 1.5
#: Up to so many decodings one after another every reading is followed.
FOLLOWED = 3
#: Within so many characters of a stretch its correct form makes it a quotation.
QUOTE_REACH = 24


def _decoding(name: str) -> str:
    """256 characters; a byte that the encoding leaves undefined stands for the control character of its number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars)


DECODE = {name: _decoding(name) for name in SINGLE_BYTE}
#: By encoding, code point to byte; all of the table's characters and, where free, the controls.
ENCODE: dict[str, dict[int, int]] = {}
for _name, _chars in DECODE.items():
    # Viewers differ in what they make of undefined bytes and controls: either maps back.
    ENCODE[_name] = {b: b for b in range(128, 160)} | {ord(c): b for b, c in reversed(list(enumerate(_chars)))}


#: A replacement character that was read again in a wrong encoding; in iso8859-5 it looks like letters that may well meet.
_AGAIN = "|".join(
    sorted({re.escape("".join(DECODE[name][b] for b in LOST.encode())) for name in SINGLE_BYTE if name != "iso8859-5"} | {"锟斤拷", "占쏙옙", "嚙踝蕭"})
)
LOST_AGAIN = re.compile(f"(?P<spoken>[{QUOTE_MARKS_ONLY}](?:{_AGAIN})+[{QUOTE_MARKS_ONLY}])|(?:{_AGAIN})")


def as_lost(text: str) -> str:
    """The text with replacement characters that were read wrongly as such, unless they are spoken of."""
    return LOST_AGAIN.sub(lambda m: m.group("spoken") or LOST, text)


class _Bytes(dict):
    """Character to its byte in each encoding, ``?`` where it has none."""

    def __missing__(self, char: str) -> tuple[int, ...]:
        code = ord(char)
        self[char] = tuple(table.get(code, 63) for table in ENCODE.values())
        return self[char]


BYTES = _Bytes()
NAMES = tuple(ENCODE)


def _raw(chunk: str) -> dict[bytes, str]:
    """The chunk's bytes in each encoding, one per character, ``?`` where it has none; with the first encoding that gives them."""
    if len(BYTES) > 100_000:
        BYTES.clear()
    out: dict[bytes, str] = {}
    for raw, name in zip(zip(*map(BYTES.__getitem__, chunk)), NAMES):
        out.setdefault(bytes(raw), name)
    return out


#: UTF-8's forms of more than one byte, by ranges of bytes.
_TAIL = (0x80, 0xBF)
FORMS = (
    ((0xC2, 0xDF), _TAIL), ((0xE0, 0xE0), (0xA0, 0xBF), _TAIL), ((0xE1, 0xEC), _TAIL, _TAIL), ((0xED, 0xED), (0x80, 0x9F), _TAIL), ((0xEE, 0xEF), _TAIL, _TAIL),
    ((0xF0, 0xF0), (0x90, 0xBF), _TAIL, _TAIL), ((0xF1, 0xF3), _TAIL, _TAIL, _TAIL), ((0xF4, 0xF4), (0x80, 0x8F), _TAIL, _TAIL),
)


def _covered(name: str) -> re.Pattern:
    """Chunks all of whose characters beyond ASCII but punctuation are well-formed UTF-8 in a single-byte encoding, or lie at lost bytes."""

    def one_of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in sorted(ENCODE[name].items()) if low <= b <= high) + "]"

    forms = "|".join("".join(one_of(*r) for r in form) for form in FORMS)
    return re.compile(f"(?:{forms}|[\x00-\x7f{LOST}“”„‘’«»…–—]|[^\x00-\x7f]{{1,3}}{LOST})*+")


COVERED = {name: _covered(name) for name in ENCODE}
#: The first character beyond ASCII must be punctuation or a lead byte: by character, the encodings in which it is that.
PUNCTUATION = "“”„‘’«»…–—"
LEADS: dict[str, list[str]] = {}
for _name, _table in ENCODE.items():
    for _code, _byte in _table.items():
        if 0xC2 <= _byte <= 0xF4:
            LEADS.setdefault(chr(_code), []).append(_name)


def covered_by(chunk: str) -> list[str]:
    """The encodings in which the chunk as a whole is well-formed UTF-8, so that it is likely UTF-8 read in one of them."""
    if not ADJACENT.search(chunk):
        return []
    first = WIDE.search(chunk).group()
    likely = COVERED if first in PUNCTUATION or LOST in chunk else LEADS.get(first, ())
    names = [name for name in likely if COVERED[name].fullmatch(chunk) and UTF8_RUN.search(codecs.charmap_encode(chunk, "replace", ENCODE[name])[0])]
    for name in MULTI_BYTE if EASTERN.search(chunk) else ():
        raw = chunk.encode(name, "ignore")
        high = sum(map(len, HIGH.findall(raw)))
        # By chance a character or two may be well-formed; at lost bytes up to three more aren't.
        if (inside := sum(map(len, UTF8_RUN.findall(raw)))) >= 6 and high - inside <= 3 * chunk.count(LOST):
            names.append(name)
    return names


def as_counted(text: str, memory: dict[str, list[str]]) -> str:
    """What of a text tells how usual characters are.

    Stretches of three chunks or more that are UTF-8 read in one encoding don't, however many texts hold them (a word may be
    well-formed by chance, such as ``только`` in cp866); if nearly all of a text is, its right reading does.
    """
    if not ADJACENT.search(text):
        return text
    chunks = SPACES.split(text)
    wide = [i for i, chunk in enumerate(chunks) if ADJACENT.search(chunk)]
    ways: dict[str, int] = defaultdict(int)
    open_: dict[str, list[int]] = {}
    likely: set[int] = set()
    for i in [*wide, -1]:
        names = [] if i < 0 else memory.get(chunks[i])
        if names is None:
            if len(memory) > 100_000:
                memory.clear()
            names = memory[chunks[i]] = covered_by(chunks[i])
        for name in names:
            ways[name] += 1
        for name in [n for n in open_ if n not in names]:
            stretch = open_.pop(name)
            if len(stretch) > 2 or name in MULTI_BYTE and sum(len(chunks[j]) for j in stretch) > 8:
                likely.update(stretch)
        for name in names:
            open_.setdefault(name, []).append(i)
    if not likely:
        return text
    way = max(ways, key=ways.__getitem__)
    whole = len(likely) >= 0.9 * len(wide)
    for i in likely:
        if not whole or way not in memory.get(chunks[i], covered_by(chunks[i])):
            chunks[i] = ""
        elif way in ENCODE:
            chunks[i] = along(f"utf-8 as {way}", chunks[i])
        else:
            chunks[i] = chunks[i].encode(way, "ignore").decode("utf-8", "ignore")
    text = " ".join(chunks)
    return as_counted(text, memory) if whole else text  # it may be garbled twice


def _codes(text: str) -> np.ndarray:
    """Code points between two blanks; digits as one, line ends and tabs as blanks."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    codes = np.concatenate([[32], codes, [32]])
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[(codes == 9) | (codes == 10) | (codes == 13)] = 32
    return codes


def _slot(a, b, kind=0):
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (b >> 3) ^ (kind * 0x27D4EB2F)) & ((1 << BITS) - 1)


def _shape(code):
    """Coarse class of a neighbour: 0 blank or mark, 1 digit, 2 lower case, 3 upper case, 4 beyond ASCII."""
    return np.select([code > 127, code == 48, (code >= 97) & (code <= 122), (code >= 65) & (code <= 90)], [4, 1, 2, 3], 0)


def features(texts: list[str]) -> np.ndarray:
    """For each text once: the slots of its pairs with a character beyond ASCII, and of its lone such characters between their neighbours' classes."""
    # Three blanks around each text keep pairs and neighbours apart, and let its ends count like its middle.
    u = _codes("".join(f"   {t}" for t in texts) + "   ")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    owner = np.concatenate([[0], owner, np.full(4, len(texts) - 1)])
    a, b = u[:-1], u[1:]
    wide = np.flatnonzero((a > 127) | (b > 127))
    slots = [_slot(a[wide], b[wide])]
    # A pair belongs to the text of the character beyond ASCII in it.
    owners = [np.where(a[wide] > 127, owner[wide], owner[wide + 1])]
    lone = np.flatnonzero((u[1:-3] == 32) & (u[2:-2] > 127) & (u[3:-1] == 32)) + 2
    slots.append(_slot(u[lone], _shape(u[lone - 2]) * 8 + _shape(u[lone + 2]), 1))
    owners.append(owner[lone])
    return np.unique(np.concatenate(owners) << BITS | np.concatenate(slots)) & ((1 << BITS) - 1)


def _groups(texts: Iterator[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in groups of about so many characters."""
    group, length = [], 0
    for text in texts:
        group.append(text)
        length += len(text)
        if length >= size:
            yield group
            group, length = [], 0
    if group:
        yield group


def pair_counts(documents: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Distinct texts per slot, over all documents, and their number. The table has ``2 ** BITS`` entries, whatever the corpus."""
    texts = F.col(text)
    # Copies count once, or many of one garbled text would make it usual. Plain ASCII texts are only counted: their hashes do.
    key = F.when(texts.rlike(r"[^\x00-\x7f]"), texts).otherwise(F.md5(texts.cast("binary")))
    rows = documents.filter(texts.isNotNull()).select(key.alias("text")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << BITS, dtype=np.int64), 0
        memory: dict[str, list[str]] = {}
        for batch in batches:
            seen += batch.num_rows
            for group in _groups(as_counted(t, memory) for t in batch.column(0).to_pylist() if not t.isascii()):
                table += np.bincount(features(group), minlength=1 << BITS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(table[used], seen))], names=["slot", "n"])

    found = rows.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, counts = found.column("slot").to_numpy(), found.column("n").to_numpy()
    table = np.zeros(1 << BITS, dtype=np.int64)
    table[slots[slots >= 0]] = counts[slots >= 0]
    return table, int(counts[slots < 0].sum())


class Restorer:
    """Finds and undoes wrong decoding, given the corpus' counts."""

    def __init__(self, counts: np.ndarray, documents: int, ways: tuple[str, ...] = WAYS) -> None:
        self.ways = ways
        self.log_counts = np.log(counts + 0.5).astype(np.float64)
        self.usual = memoryview(self.log_counts)
        self.rare = float(np.log(max(4.0, 0.02 * documents)))
        # Memories of what was computed, cleared when they grow large.
        self.known: dict[str, list] = {}
        self.pairs: dict[str, float] = {}

    def weigh_all(self, chunk: str, others: list[str]) -> tuple[list[float], list[float]]:
        """For each of the other strings the mean log count of its pairs, and if it is as long as the chunk the mean gain over the pairs that differ."""
        rows = [chunk, *others]
        sizes = np.array([len(x) for x in rows]) + 2
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(f" {x} " for x in rows).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        codes = np.where((codes >= 48) & (codes <= 57), 48, codes)
        first, second = codes[:-1], codes[1:]
        wide = (first > 127) | (second > 127)
        value = np.where(wide, self.log_counts[_slot(first, second)], self.rare)
        own = f" {chunk} ".translate(ONE_DIGIT)
        value[: sizes[0] - 1] = [self.pair(p) for p in map(str.__add__, own, own[1:])]
        # Pairs of two strings' ends aren't wide, as both are blanks.
        starts = ends - sizes
        n = np.add.reduceat(wide, starts)
        total = np.add.reduceat(np.where(wide, value, 0.0), starts)
        mean = np.where(n > 0, total / np.maximum(n, 1), 99.0)
        local = np.zeros(len(rows))
        alike = np.flatnonzero(sizes == sizes[0])
        at = starts[alike][:, None] + np.arange(sizes[0] - 1)[None, :]
        differs = (first[at] != first[at[:1]]) | (second[at] != second[at[:1]])
        local[alike] = np.where(differs, value[at] - value[at[:1]], 0.0).sum(axis=1) / np.maximum(differs.sum(axis=1), 1)
        return mean[1:].tolist(), local[1:].tolist()

    def inner(self, text: str) -> float:
        """Mean over the pairs within the stretches of a text (NUL between them), without their surroundings."""
        pairs = [p for p in map(str.__add__, text, text[1:]) if "\0" not in p]
        return sum(map(self.pair, pairs)) / len(pairs) if pairs else -99.0

    def pair(self, pair: str) -> float:
        """Log count of a pair of characters; plain ASCII counts as usual."""
        if pair.isascii():
            return self.rare
        x = self.pairs.get(pair)
        if x is None:
            x = self.pairs[pair] = self.usual[_slot(ord(pair[0]), ord(pair[1]))]
        return x

    def weigh(self, chunk: str) -> tuple[float, float]:
        """Mean and least log count of the chunk's pairs."""
        text = f" {chunk.translate(ONE_DIGIT)} "
        total, n, least = 0.0, 0, 99.0
        for pair in map(str.__add__, text, text[1:]):
            if not pair.isascii():
                x = self.pairs.get(pair)
                if x is None:
                    x = self.pairs[pair] = self.usual[_slot(ord(pair[0]), ord(pair[1]))]
                total, n = total + x, n + 1
                if x < least:
                    least = x
        return (total / n if n else 99.0), least

    def candidates(self, chunk: str) -> list[tuple[str, str, float]]:
        """(how, restored, gain) of what the chunk may have been, best first; empty if it looks usual."""
        if chunk in self.known:
            return self.known[chunk]
        if len(self.known) > 100_000 or len(self.pairs) > 1_000_000:
            self.known.clear()
            self.pairs.clear()
        out: list[tuple[str, str, float]] = []
        mean, least = self.weigh(chunk)
        if least < self.rare or covered_by(chunk):
            found: dict[str, str] = {}
            raws = _raw(chunk)
            spans = utf8_spans(chunk, raws) if ADJACENT.search(chunk) else {}
            front = {d: how for d, (how, _, _) in spans.items()}
            found |= front
            depth = 1
            while front:  # garbled twice, three times, ..: each decoding shortens the text
                if depth >= FOLLOWED:
                    # The readings multiply with each decoding; beyond three the likeliest is followed.
                    some = [d for d in front if ADJACENT.search(d)]
                    means, _ = self.weigh_all(chunk, some)
                    front = {d: front[d] for d in some if d == some[int(np.argmax(means))]}
                depth += 1
                again = {d: f"{how}+{h}" for x, how in front.items() if ADJACENT.search(x) for d, (h, _, _) in utf8_spans(x, _raw(x)).items()}
                front = {d: how for d, how in again.items() if d not in found and d != chunk}
                found |= front
            for d, h in other_spans(chunk, raws).items():
                found.setdefault(d, h)
            if "bytes" in self.ways:
                for d, h in (*foreign_bytes(chunk, raws).items(), *self.part_of(chunk).items()):
                    found.setdefault(d, h)
            wide = wide_spans(chunk, self.inner)
            for d, (h, _, _) in wide.items():
                found.setdefault(d, h)
            behind = set()
            lost, controls = chunk.count(LOST), len(CONTROLS.findall(chunk))
            # No right reading has more controls or lost characters than the wrong one.
            kept = [(d, h) for d, h in found.items() if d.count(LOST) <= lost and len(CONTROLS.findall(d)) <= controls]
            for (d, h), new_mean, local in zip(kept, *self.weigh_all(chunk, [d for d, _ in kept])) if kept else ():
                gain = new_mean - mean
                if len(d) == len(chunk):
                    # Sound letters beside the garbled ones must not drown the gain of these.
                    if local <= 0:
                        continue  # nor can the mean have gained
                    gain = max(gain, local - LOCAL_EXTRA)
                if d in wide and d not in spans:
                    # Sound text beside the spans mustn't drown their gain; a reading of the whole comes first where there is one.
                    least_gain = LEAST_GAIN_SPAN if h.startswith("utf-8") else LEAST_GAIN_BYTES
                    if gain <= least_gain:
                        local = self.inner(wide[d][2]) - self.inner(wide[d][1]) - LOCAL_EXTRA if len(wide[d][1].replace("\0", "")) > 2 else gain
                        gain = max(gain, min(local, least_gain + 0.1))
                        behind.add(d)
                if d in spans and len(spans[d][2].replace("\0", "")) > 2:
                    # Where bytes are lost between the spans, what lies in the spans must speak for itself.
                    gain = max(gain, self.inner(spans[d][2]) - self.inner(spans[d][1]) - LOCAL_EXTRA)
                if gain > 0:
                    out.append((h, d, gain))
            out.sort(key=lambda x: (x[1] in behind, -x[2]))
        self.known[chunk] = out
        return out

    def part_of(self, chunk: str) -> dict[str, str]:
        """Readings that change only the chunk's rare characters, where a garbled stretch begins or ends within it."""
        text = f" {chunk} "
        wide = [i for i, c in enumerate(chunk) if ord(c) > 127]
        odd = [i for i in wide if max(self.pair(text[i : i + 2]), self.pair(text[i + 1 : i + 3])) < self.rare - 2]
        if not odd or len(odd) == len(wide):
            return {}
        some = "".join(chunk[i] for i in odd)
        out: dict[str, str] = {}
        for new, how in foreign_bytes(some, _raw(some)).items():
            chars = list(chunk)
            for i, c in zip(odd, new):
                chars[i] = c
            out.setdefault("".join(chars), how)
        return out

    def lone(self, text: str, at: int, old: str, new: str) -> float:
        """Gain of replacing a lone character, judged by its neighbours' classes."""
        near = [_shape(_codes(text[i])[1]) if 0 <= i < len(text) else 0 for i in (at - 2, at + len(old) + 1)]
        sides = int(near[0]) * 8 + int(near[1])
        return self.usual[_slot(ord(new), sides, 1)] - self.usual[_slot(ord(old), sides, 1)]

    def examine(self, text: str) -> tuple[bool, bool, str, str, int]:
        """(found, whole, restored text, how, stretches): ``whole`` if nothing of the text is lost."""
        text = as_lost(text)
        lossy = "lost" in self.ways and LOST in SPOKEN_OF.sub("", text)
        chunks = []
        votes: dict[str, float] = defaultdict(float)
        end = 0
        for chunk in SPACES.split(text):
            if not chunk.isascii():
                at = text.find(chunk, end)
                end = at + len(chunk)
                options = self.candidates(chunk)
                chunks.append((at, chunk, options))
                for how, _, gain in options:
                    votes[how] += gain
        found = False
        picked = []
        edits: list[tuple[int, str, str]] = []
        hows: dict[str, int] = defaultdict(int)
        main = max(votes, key=votes.__getitem__, default="")
        for at, chunk, options in chunks:
            # One stretch was garbled in one way: the way most of the text speaks for is preferred.
            if main.startswith("utf-8") and ADJACENT.search(chunk) and all(o[0] != main for o in options):
                new = along(main, chunk)
                if new != chunk and (gain := self.weigh(new)[0] - self.weigh(chunk)[0]) > 0:
                    options = sorted([*options, (main, new, gain)], key=lambda o: -o[2])
            if not options:
                continue
            how, new, gain = next((o for o in options if o[0] == main and o[2] >= 0.6 * options[0][2]), options[0])
            picked.append((at, chunk, how, new, gain, quoted(text, at, chunk, new)))
        # A mark may well stand next to its like by chance: it is quoted only along with a word that is.
        worded = any(q and any(c.isalnum() for c in new) for *_, new, _, q in picked)
        for at, chunk, how, new, gain, beside in picked:
            if beside and (worded or any(c.isalnum() for c in new)):
                continue
            strong = self.strong(text, at, chunk, how, new, gain)
            found = found or strong
            if strong or (how == main and gain > 0.5):
                edits.append((at, chunk, new))
                hows[how] += 1
        if not found and not lossy:
            return False, True, text, "", 0
        parts, end = [], 0
        for at, chunk, new in edits:
            parts += [text[end:at], new]
            end = at + len(chunk)
        restored = as_lost("".join(parts) + text[end:])
        return True, LOST not in SPOKEN_OF.sub("", restored), restored, max(hows, key=hows.__getitem__, default=""), len(edits)

    def strong(self, text: str, at: int, chunk: str, how: str, new: str, gain: float) -> bool:
        """Whether the chunk alone is evidence enough."""
        if how.startswith("utf-8"):
            return gain > LEAST_GAIN_SPAN
        if CONTROLS.search(chunk) and not CONTROLS.search(new):
            return gain > 0.5
        if gain <= LEAST_GAIN_BYTES:
            return False
        if len(chunk) == 1:
            return len(new) == 1 and self.lone(text, at, chunk, new) > LEAST_GAIN_BYTES
        wide = sum(ord(c) > 127 for c in chunk)
        return wide > 1 or any(c.isascii() and c.isalnum() for c in chunk)


def quoted(text: str, at: int, chunk: str, new: str) -> bool:
    """Whether the correct form stands right next to the chunk."""
    core = new.strip(QUOTE_MARKS)
    end = at + len(chunk)
    return bool(core) and (core in text[end : end + QUOTE_REACH + len(core)] or core in text[max(0, at - QUOTE_REACH - len(core)) : at])


def _splice(chunk: str, raw: bytes, run: re.Pattern, name: str) -> str | None:
    """The chunk with the well-formed runs of its bytes (one per character) decoded; null if there is none."""
    parts, end = [], 0
    for m in run.finditer(raw):
        try:
            decoded = m.group().decode(name)
        except UnicodeDecodeError:
            continue
        parts += [chunk[end : m.start()], decoded]
        end = m.end()
    return "".join(parts) + chunk[end:] if parts else None


def utf8_spans(chunk: str, raws: dict[bytes, str]) -> dict[str, tuple[str, str, str]]:
    """What the chunk becomes if UTF-8 was read as a single-byte encoding: how, and its spans before and after."""
    out: dict[str, tuple[str, str, str]] = {}
    for raw, name in raws.items():
        if not UTF8_RUN.search(raw):
            continue
        new = _splice(chunk, raw, UTF8_RUN, "utf-8")
        if new is not None and new not in out:
            places = [m.span() for m in UTF8_RUN.finditer(raw)]
            out[new] = f"utf-8 as {name}", "\0".join(chunk[i:j] for i, j in places), b"\0".join(raw[i:j] for i, j in places).decode("utf-8")
    return out


def along(how: str, chunk: str) -> str:
    """The chunk taken back along a way such as ``utf-8 as cp1252+utf-8 as cp850``."""
    for name in (step.removeprefix("utf-8 as ") for step in how.split("+")):
        if name not in ENCODE:
            return chunk
        raw = codecs.charmap_encode(chunk, "replace", ENCODE[name])[0]
        chunk = _splice(chunk, raw, UTF8_RUN, "utf-8") or chunk
    return chunk


def other_spans(chunk: str, raws: dict[bytes, str]) -> dict[str, str]:
    """UTF-8 read as a multibyte encoding, and East Asian encodings read as a single-byte one."""
    out: dict[str, str] = {}
    # UTF-8's lead bytes lie where these encodings have their Han characters, syllables or half-width signs.
    for name in MULTI_BYTE if EASTERN.search(chunk) else ():
        raw = chunk.encode(name, "replace")
        if raw.isascii():
            continue  # the encoding has none of the characters
        new = raw.decode("utf-8", "replace")
        if new != chunk:
            # A byte that had no partner is lost; a few of them are bearable, a text full of them is another text.
            fresh = new.count(LOST) - chunk.count(LOST)
            if fresh <= 0 and new.count("?") - chunk.count("?") <= max(chunk.count(LOST) * 2, len(chunk) // 12):
                out.setdefault(new, f"utf-8 as {name}")
    adjacent, several = ADJACENT.search(chunk), len(WIDE.findall(chunk)) > 1
    for raw, name in raws.items():
        for true, run in RUNS.items():
            # EUC's bytes are all high; Shift-JIS' second ones may be plain.
            if not (several if run is SJIS_RUN else adjacent):
                continue
            new = _splice(chunk, raw, run, true)
            if new is not None and new != chunk:
                out.setdefault(new, f"{true} as {name}")
    return out


class _Encoder(dict):
    """Character to its bytes in a multibyte encoding; where it has none, a byte that no automaton takes."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __missing__(self, char: str) -> bytes:
        try:
            self[char] = char.encode(self.name)
        except UnicodeEncodeError:
            self[char] = b"\xff"
        return self[char]


ENCODERS = {name: _Encoder(name) for name in MULTI_BYTE}
#: Characters that cp932 has twice, by the bytes they aren't encoded to.
TWICE: dict[str, bytes] = {}
for _raw_bytes in (bytes([a, b]) for a in range(0xED, 0xFD) for b in range(0x40, 0xFD)):
    try:
        _char = _raw_bytes.decode("cp932")
    except UnicodeDecodeError:
        continue
    if len(_char) == 1 and _char.encode("cp932") != _raw_bytes:
        TWICE[_char] = _raw_bytes
SECOND = _Encoder("cp932")
SECOND.update(TWICE)
WIDE_RUNS = {"utf-8": UTF8_RUN} | RUNS


def viewed(chunk: str) -> Iterator[tuple[str, bytes, list[int]]]:
    """For each multibyte encoding the chunk's bytes, and where each character begins (and the last ends)."""
    encoders = list(ENCODERS.items())
    if not TWICE.keys().isdisjoint(chunk):
        encoders.append(("cp932", SECOND))
    for name, encoder in encoders:
        parts = list(map(encoder.__getitem__, chunk))
        raw = b"".join(parts)
        if not raw.isascii():
            yield name, raw, [0, *accumulate(map(len, parts))]


def _wide_span(chunk: str, raw: bytes, starts: list[int], first: int, run: re.Pattern, true: str) -> tuple[str, int]:
    """The text of the span that begins at a byte, and the number of the character where it ends, which is where a character does.

    Up to three bytes between a span and a replacement character are lost with it.
    """
    reach = 64
    while True:
        # Most spans are short: no more of a long text is looked at than is needed.
        m = run.match(raw, first, first + reach)
        if m is None:
            return "", 0
        try:
            text = m.group().decode(true)
        except UnicodeDecodeError as e:
            text = m.group()[: e.start].decode(true)
            break
        if m.end() < first + reach - 4 or first + reach >= len(raw):
            break
        reach *= 4
    last = first + len(text.encode(true))
    after = bisect_left(starts, last)
    lost = chunk.find(LOST, after, after + 4)
    if text and lost > 0 and starts[lost] - last < 4 and not ASCII.search(chunk, after, lost):
        return text, lost
    while text and starts[bisect_left(starts, last)] != last:
        last -= len(text[-1].encode(true))
        text = text[:-1]
    return text, bisect_left(starts, last)


def _splice_wide(chunk: str, raw: bytes, starts: list[int], run: re.Pattern, true: str, judge: Callable[[str], float]) -> tuple[str, str, str] | None:
    """As ``_splice``, where a character has several bytes: the chunk with its spans decoded, the spans before and after.

    A span begins and ends where characters do and takes two or more of them, as one may be well-formed by chance. After a
    replacement character the first byte may have lost its partner: the better reading counts.
    """
    parts, before, after = [], [], []
    end = at = 0
    while m := run.search(raw, at):
        begin = bisect_left(starts, m.start())
        first = starts[begin]
        if first >= m.end():
            at = m.end()
            continue
        text, stop = _wide_span(chunk, raw, starts, first, run, true)
        if begin and chunk[begin - 1] == LOST:
            other = _wide_span(chunk, raw, starts, first + 1, run, true)
            if other[0] and (not text or judge(other[0]) > judge(text)):
                text, stop = other
        if stop - begin < 2 or not text or text.isascii():
            at = starts[begin + 1]
            continue
        parts += [chunk[end:begin], text]
        before.append(chunk[begin:stop])
        after.append(text)
        end = stop
        at = starts[end]
    return ("".join(parts) + chunk[end:], "\0".join(before), "\0".join(after)) if parts else None


def wide_spans(chunk: str, judge: Callable[[str], float]) -> dict[str, tuple[str, str, str]]:
    """What the chunk becomes if its spans were read as a multibyte encoding: how, and its spans before and after."""
    out: dict[str, tuple[str, str, str]] = {}
    for name, raw, starts in viewed(chunk) if EASTERN.search(chunk) else ():
        for true, run in WIDE_RUNS.items():
            if true != name and (new := _splice_wide(chunk, raw, starts, run, true, judge)) is not None and new[0] != chunk:
                out.setdefault(new[0], (f"{true} as {name}", *new[1:]))
    return out


def foreign_bytes(chunk: str, raws: dict[bytes, str]) -> dict[str, str]:
    """One single-byte encoding read as another."""
    out: dict[str, str] = {}
    marks = chunk.count("?")
    for raw, name in raws.items():
        if raw.count(b"?") != marks:
            continue  # some character isn't in this encoding
        for true, chars in DECODE.items():
            if true != name:
                new = codecs.charmap_decode(raw, "strict", chars)[0]
                if new != chunk:
                    out.setdefault(new, f"{true} as {name}")
    return out


#: The restorer that this worker used last, with what it remembers, and the broadcast it was made of.
_LAST: list = []


def _restorer(shared: Broadcast, ways: tuple[str, ...]) -> Restorer:
    if not _LAST or _LAST[0] is not shared or _LAST[1].ways != ways:
        _LAST[:] = [shared, Restorer(*shared.value, ways)]
    return _LAST[1]


def way_of(how: str) -> str:
    """The way that ``how`` belongs to."""
    return "lost" if not how else "spans" if how.split(" as ")[0] in ("utf-8", *RUNS) else "bytes"


def restore_spans(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """As :func:`restore`, by maximal well-formed multibyte spans only, which are all that is decoded."""
    return restore(documents, doc_id, text, ("spans",))


def restore(documents: DataFrame, doc_id: str, text: str, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """The documents with wrongly decoded text.

    Returns ``doc_id, restored, whole`` (whether nothing is left that can't be
    restored), ``way`` (of :data:`WAYS`: the one of most stretches, ``lost`` if
    only replacement characters gave the text away), ``how`` (true and wrong
    encoding of most stretches, empty for ``lost``), ``stretches``. Only the
    ``ways`` asked for are tried.

    Defined cases: null, empty and pure ASCII texts are never found; texts of any
    length are examined whole; repeated texts are each found; quoted garbled
    characters next to their correct form, and a lone replacement character in
    quotes, are not; decomposed letters, full-width forms, entities and other
    unusual spellings are not; an empty table yields no row; other columns,
    whatever their names, are ignored.
    """
    if not ways or set(ways) - set(WAYS):
        raise ValueError(f"ways must be some of {WAYS}")
    counts, total = pair_counts(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast((counts, total))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("restored", T.StringType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("way", T.StringType()),
            T.StructField("how", T.StringType()),
            T.StructField("stretches", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared, ways)
        for batch in batches:
            seen = [restorer.examine(t) for t in batch.column(1).to_pylist()]
            hit = [i for i, x in enumerate(seen) if x[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(hit, pa.int64())),
                    pa.array([seen[i][2] for i in hit], pa.string()),
                    pa.array([seen[i][1] for i in hit], pa.bool_()),
                    pa.array([way_of(seen[i][3]) for i in hit], pa.string()),
                    pa.array([seen[i][3] for i in hit], pa.string()),
                    pa.array([seen[i][4] for i in hit], pa.int32()),
                ],
                names=["doc_id", "restored", "whole", "way", "how", "stretches"],
            )

    return rows.mapInArrow(run, schema)
