"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

A text is a lattice whose edges are vocabulary pieces.  With Gumbel noise on the log-probability of every segmentation, the ``k`` largest perturbed
values are a sample of ``k`` distinct segmentations.  They are found by best-first (A-star) search from the text's start: a partial segmentation is worth the largest perturbed
value below it, which is drawn top-down, each node's children given their maximum: which child has it, and the maximum of the others together, which are parted only
when the search comes back to them.  The best open node's best child has its value, so
a search step is one descent to the end; descents are laid out as arrays over all words of some texts.  All noise is a hash
of the row's key and the place on the path, so a row's samples depend on nothing else.
"""

from __future__ import annotations

import math
import mmap
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import clean_name, map_arrow, slabs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text.
SAMPLES = 2
#: Natural logarithm of the probability of a byte piece (bytes stand for characters that have no piece).
BYTE_SCORE = -14.0
#: Nodes of lattices from which on a task forgets words; a node takes some 60 bytes.
KEPT_NODES = 600_000
#: Bytes of texts that are cut into words at once, and characters of those among them that are descended together.
_SLAB, _PART = 1 << 19, 1 << 17
#: Characters of new words whose lattices are made together.
_BATCH = 1 << 14
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n|[^{_SPACE}\n]+")
_ESCAPED = 1 << 20
_LAST = 128
_NEAR = 16
_UNITS = 2.0**32
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _exponential(h: np.ndarray) -> np.ndarray:
    """Exponential variates; the negative logarithm of one is Gumbel noise."""
    return -np.log(_uniform(h))


_SLOT_BITS = 18
_SLOTS = (64 - _SLOT_BITS, 20, 33, 7)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash_sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any run of characters follows."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _powers(1 << max(12, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes + _U(77)) * up[: len(codes)], out=sums[1:])
    return sums, down


def _slot(h: np.ndarray, shift: int) -> np.ndarray:
    return (((h * _U(0xD6E8FEB86659FD93)) >> _U(shift)) & _U((1 << _SLOT_BITS) - 1)).astype(np.int64)


class Vocabulary:
    """Pieces of a SentencePiece model as a unigram distribution: probability proportional to 1 / (rank + 2), rank being the order in which they were learnt."""

    def __init__(self, path: str = MODEL) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int64)
        usable: dict[str, int] = {}
        rank: dict[int, float] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and _SPACE not in piece.lstrip(_SPACE):
                usable[piece] = i
                rank[i] = max(0.0, -model.get_score(i)) if model.get_score(i) > -1e6 else float(n)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        #: What each id decodes to.
        self.bytes_of = [p.replace(_SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_id.tolist()):
            self.bytes_of[i] = bytes((b,))
        self.byte_table = pa.array(self.bytes_of, pa.large_binary())
        self.score = np.full(n, -np.inf)
        ids = np.array(list(rank))
        self.score[ids] = -np.log(np.array(list(rank.values())) + 2)
        self.score[ids] -= np.log(np.exp(self.score[ids]).sum())
        self.size = np.array([len(p) for p in self.pieces])
        # prefixes of pieces by length and hash, each in one of a few direct tables: a trie that is walked from all places at once
        self.lengths: list[tuple[int, list[np.ndarray]]] = []
        hash_of, piece_of = [np.zeros(1, np.uint64)], [np.full(1, -1)]
        total = 1
        for length in range(1, max(map(len, usable)) + 1):
            own = sorted({p[:length] for p in usable if len(p) >= length})
            sums, down = _hash_sums("".join(own))
            at = np.arange(len(own)) * length
            hash_of.append((sums[at + length] - sums[at]) * down[at])
            piece_of.append(np.array([usable.get(p, -1) for p in own]))
            left, tables = np.arange(len(own)), []
            for shift in _SLOTS:
                if not len(left):
                    break
                table = np.zeros(1 << _SLOT_BITS, np.int32)
                slot = _slot(hash_of[-1][left], shift)
                _, first = np.unique(slot, return_index=True)
                table[slot[first]] = left[first] + total
                tables.append(table)
                left = np.delete(left, first)
            if len(left):
                raise ValueError("two prefixes share all of their slots")
            total += len(own)
            self.lengths.append((length, tables))
        self.hash_of, self.piece_of = np.concatenate(hash_of), np.concatenate(piece_of)

    def find(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``(places, ids)`` of every piece that begins at any place of ``text``, by length, then place."""
        sums, down = _hash_sums(text)
        alive = np.arange(len(text))
        places, ids = [], []
        for length, tables in self.lengths:
            alive = alive[: np.searchsorted(alive, len(text) - length, side="right")]
            h = (sums[alive + length] - sums[alive]) * down[alive]
            got = tables[0][_slot(h, _SLOTS[0])]
            miss = np.flatnonzero(self.hash_of[got] != h)
            for table, shift in zip(tables[1:], _SLOTS[1:], strict=False):
                again = table[_slot(h[miss], shift)]
                found = self.hash_of[again] == h[miss]
                got[miss[found]] = again[found]
                miss = miss[~found]
            ok = np.ones(len(alive), bool)
            ok[miss] = False
            alive, got = alive[ok], self.piece_of[got[ok]]
            whole = got >= 0
            places.append(alive[whole])
            ids.append(got[whole])
        return np.concatenate(places), np.concatenate(ids)

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of segmentations that lie end to end in ``ids``, with the space that precedes every text."""
        got = self.byte_table.take(pa.array(ids))
        whole = got.buffers()[2].to_pybytes() if len(ids) else b""
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1][np.cumsum(sizes)] if len(ids) else np.zeros(len(sizes), np.int64)
        return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:]


@lru_cache(1)
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def _room(n: int, kind: type) -> np.ndarray:
    """A table of ``n`` numbers in pages of its own: those that are not written yet take no memory, and all go back to the system with the table."""
    return np.frombuffer(mmap.mmap(-1, n * np.dtype(kind).itemsize, flags=mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS), kind)


class Lattices:
    """The lattices of distinct words, kept over slabs: nodes are places in words, edges are grouped by the node that they leave."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        #: By node: its first edge, their number, the share of all but one that has over a half, and whether a later slab has had the word again.
        self.first, self.count, self.rest, self.asked = _room(1 << 16, np.int64), _room(1 << 16, np.uint8), _room(1 << 16, np.float64), _room(1 << 16, np.bool_)
        #: By edge: its characters (with ``_LAST`` if the word ends there), its piece, and its probability among the edges of its node.
        self.span, self.piece, self.share = _room(1 << 16, np.uint8), _room(1 << 16, np.int32), _room(1 << 16, np.float64)
        self.clear()

    def clear(self) -> None:
        """Forget all words; the tables keep their room."""
        self.start: dict[str, int] = {}
        self.nodes = self.edges = 0
        #: Characters of several bytes without a piece, by what is added to ``_ESCAPED``.
        self.escaped: list[bytes] = []
        self.escape_of: dict[str, tuple[int, float]] = {}

    def thin(self) -> None:
        """Forget the words that no later slab has had again, or all if too many are left."""
        words, at = list(self.start), np.fromiter(self.start.values(), np.int64, len(self.start))
        keep, sizes = self.asked[at], np.diff(np.append(at, self.nodes))
        kept = int(sizes[keep].sum())
        if kept > KEPT_NODES // 2:
            self.clear()
            return
        # words lie in the order of their first nodes, edges in the order of their nodes
        nodes = np.repeat(keep, sizes)
        edges = np.repeat(nodes, self.count[: self.nodes])
        for name, mask in (("count", nodes), ("rest", nodes), ("span", edges), ("piece", edges), ("share", edges)):
            held = getattr(self, name)
            some = held[: len(mask)][mask]
            held[: len(some)] = some
        count = self.count[:kept].astype(np.int64)
        self.first[:kept] = np.cumsum(count) - count
        self.asked[:kept] = False
        self.start = dict(zip(compress(words, keep.tolist()), (np.cumsum(sizes[keep]) - sizes[keep]).tolist(), strict=True))
        self.nodes, self.edges = kept, int(count.sum())

    def _append(self, name: str, at: int, values: np.ndarray) -> None:
        """Put values at the end of a table that doubles when it is full."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            wider = _room(max(2 * len(held), at + len(values)), held.dtype)
            wider[:at] = held[:at]
            setattr(self, name, held := wider)
        held[at : at + len(values)] = values

    def add(self, words: list[str]) -> np.ndarray:
        """The first nodes of words; lattices are made of those that are new."""
        nodes = np.fromiter(map(self.start.get, words, repeat(-1)), np.int64, len(words))
        self.asked[nodes[nodes >= 0]] = True
        missing = np.flatnonzero(nodes < 0).tolist()
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            ends = np.cumsum([len(w) for w in new])
            at = 0
            while at < len(new):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BATCH, side="right")))
                self._make(new[at:stop])
                at = stop
            nodes[missing] = [self.start[words[i]] for i in missing]
        return nodes

    def _make(self, new: list[str]) -> None:
        base, edge_base = self.nodes, self.edges
        text = "\n".join(["\0" if w == "\n" else w for w in new]) + "\n"
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes + 1) - 1
        self.start.update(zip(new, (base + ends - sizes).tolist(), strict=True))
        begin, ident = self.vocab.find(text)
        size = self.vocab.size[ident]
        covered = np.zeros(len(text), bool)
        covered[begin[size == 1]] = True
        covered[ends] = True
        bare = np.flatnonzero(~covered)
        codes = np.empty(len(bare), np.int64)
        bare_score = np.empty(len(bare))
        for k, at in enumerate(bare.tolist()):
            char = text[at]
            if char not in self.escape_of:
                real = _real(char).encode("utf-8", "surrogatepass")
                # one byte is a piece; more are told apart when ids are listed
                code = int(self.vocab.byte_id[real[0]])
                if len(real) > 1:
                    code = _ESCAPED + len(self.escaped)
                    self.escaped.append(real)
                self.escape_of[char] = (code, BYTE_SCORE * len(real))
            codes[k], bare_score[k] = self.escape_of[char]
        # backwards, so that a node's longest pieces, the likely ones, come first
        to = np.concatenate((bare + 1, begin + size))[::-1]
        begin = np.concatenate((bare, begin))[::-1]
        score = np.concatenate((bare_score, self.vocab.score[ident]))[::-1]
        piece = np.concatenate((codes, ident))[::-1]
        order = np.argsort(begin, kind="stable")
        begin, to, score, piece = begin[order], to[order], score[order], piece[order]
        count = np.bincount(begin, minlength=len(text))
        first = np.cumsum(count) - count
        # log-probability of everything from a node to its word's end, nodes nearest to the end first
        left = np.repeat(ends, sizes + 1) - np.arange(len(text))
        mass, near = np.zeros(len(text)), np.ones(len(text))
        # within so many places of the end plain sums can't leave the range of a double, each character being given what a byte costs
        weight = np.exp(score - BYTE_SCORE * (to - begin))
        lefts = left[begin]
        by_left = np.argsort(lefts.astype(np.uint16) if len(left) and left.max() < 1 << 16 else lefts, kind="stable")
        lefts = lefts[by_left]
        cut = np.flatnonzero(np.diff(lefts, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(lefts)], strict=True):
            e = by_left[a:b]
            node = begin[e]
            group = np.flatnonzero(np.diff(node, prepend=-1))
            if lefts[a] <= _NEAR:
                node = node[group]
                near[node] = np.add.reduceat(weight[e] * near[to[e]], group)
                mass[node] = np.log(near[node]) + BYTE_SCORE * left[node]
            else:
                mass[node[group]] = np.logaddexp.reduceat(score[e] + mass[to[e]], group)
        # in whole multiples of 2^-32, so that sums over a path are exact whatever lies before it in the slab
        share = np.exp(np.round((score + mass[to] - mass[begin]) * _UNITS) / _UNITS)
        # only a share over one half leaves a rest that a difference would get wrong
        rest = np.zeros(len(text))
        rest[count > 0] = np.add.reduceat(np.where(share > 0.5, 0.0, share), first[count > 0])
        self._append("first", base, first + edge_base)
        self._append("count", base, count)
        self._append("rest", base, rest)
        self._append("asked", base, np.zeros(len(text), bool))
        self._append("span", edge_base, np.where(left[to] > 0, to - begin, to - begin + _LAST))
        self._append("piece", edge_base, piece)
        self._append("share", edge_base, share)
        self.nodes += len(text)
        self.edges += len(to)


def _real(char: str) -> str:
    """What a lattice character stands for: a line end is kept as NUL; NUL and the space mark as lone surrogates, which no text has."""
    return {"\0": "\n", "\ud800": "\0", "\ud801": _SPACE}.get(char, char)


_RARE = re.compile(f"[\0{_SPACE}]")
_PROTECT = str.maketrans({" ": _SPACE, "\0": "\ud800", _SPACE: "\ud801"})


def words_of(text: str) -> list[str]:
    """The text's words for the lattice: cut before each space and around each line end."""
    if not text:
        return []
    return _UNIT.findall(_SPACE + (text.translate(_PROTECT) if _RARE.search(text) else text.replace(" ", _SPACE)))


def _cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(words, which, sizes)``: the words of texts, mostly once each, the word at each place of the texts end to end, and how many places each text has.

    What ``words_of`` gives, by Arrow for the texts that can be cut at single characters.
    """
    odd = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or "\0" in t or "\1" in t or _SPACE in t]
    plain = [f" {t}" if t else "" for t in texts]
    for i in odd:
        plain[i] = ""
    marked = pc.replace_substring(pc.replace_substring(pa.array(plain, pa.large_string()), " ", f"\1{_SPACE}"), "\n", "\1\n\1")
    cut = pc.split_pattern(marked, "\1")
    ends = np.append(0, cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py())
    coded = cut.flatten().dictionary_encode()
    # as one string: lists of strings are slower
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())), "\0")[0].as_py().split("\0")
    which = coded.indices.to_numpy().astype(np.int64)
    # between two cuts there may be nothing
    real = which != (words.index("") if "" in words else -1)
    before = np.append(0, np.cumsum(real))
    which, ends = which[real], before[ends]
    sizes = np.diff(ends)
    if odd:
        parts = np.split(which, ends[1:-1])
        for i in odd:
            own = words_of(texts[i])
            parts[i], sizes[i] = np.arange(len(words), len(words) + len(own)), len(own)
            words += own
        which = np.concatenate(parts)
    # an empty word has no lattice
    return ["\n" if w == "" else w for w in words] if "" in words else words, which, sizes


class _Descent:
    """One descent of each of some texts: path steps in order, and for each its node's other edges by the logarithm of how much later than the text's best the best of them comes."""

    __slots__ = ("doc", "edge", "late", "noise", "phi", "step_at", "step_unit", "taken", "total", "value")

    def take(self, lat: Lattices, step: int) -> tuple[int, int]:
        """The best of a step's open edges and the node that it leads to (-1 at a word's end); the best of what is left takes its place."""
        taken = self.taken.setdefault(step, [int(self.edge[step])])
        node = int(np.searchsorted(lat.first[: lat.nodes], taken[0], side="right")) - 1
        first = int(lat.first[node])
        share = {first + i: x for i, x in enumerate(lat.share[first : first + int(lat.count[node])].tolist()) if first + i not in taken}
        noise = _uniform(_mix(self.noise[step] + _NOISE * np.arange(2 * len(taken), 2 * len(taken) + 2, dtype=np.uint64))).tolist()
        place = noise[0] * sum(share.values())
        for edge, x in share.items():
            place -= x
            if place < 0:
                break
        taken.append(edge)
        del share[edge]
        gap = math.log(max(-math.log(noise[1]), 1e-300)) - math.log(max(sum(share.values()), 1e-300)) - self.phi[step]
        self.late[step] = np.logaddexp(self.late[step], gap) if share else np.inf
        span = int(lat.span[edge])
        return edge, node + span if span < _LAST else -1

    def first_open(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``n`` texts the least lateness of its steps and the first step that has it."""
        least, step = np.full(n, np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(np.diff(self.step_at))
        if len(some):
            least[some] = np.minimum.reduceat(self.late, self.step_at[some])
            hit = np.flatnonzero(self.late == np.repeat(least, np.diff(self.step_at)))[::-1]
            step[self.doc[hit]] = hit
        return least, step


_NOISE, _STEP = _U(0xA0761D6478BD642F), _U(0x8CB92BA72F3D8DD7)


def _logs(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    """Log-probabilities of edges in whole units."""
    return np.rint(np.log(np.maximum(lat.share[edges], 1e-300)) * _UNITS).astype(np.int64)


def _descend(lat: Lattices, seed: np.ndarray, salt: int, value: np.ndarray, phi: np.ndarray, occ_doc: np.ndarray, occ_unit: np.ndarray, occ_node: np.ndarray) -> _Descent:
    """From each word occurrence's node to its word's end.  ``occ_*`` are in text order; ``value`` and ``phi`` are by text."""
    steps = []
    active = np.flatnonzero(occ_node >= 0)
    node = occ_node[active]
    word = _mix(seed[occ_doc] + _U(salt * 0x9E3779B97F4A7C15 % (1 << 64)) + occ_unit.astype(np.uint64) * _U(0xD1B54A32D192ED03))
    noise = word[active]
    taken = np.zeros(len(occ_doc), np.int64)
    while len(active):
        edge = lat.first[node]
        last = edge + lat.count[node] - 1
        share = lat.share[edge]
        # the edge whose share of the unit interval holds a random place
        place = _uniform(_mix(noise)) - share
        beyond = np.flatnonzero((place >= 0) & (edge < last))
        while len(beyond):
            on = edge[beyond] + 1
            edge[beyond] = on
            share[beyond] = own = lat.share[on]
            here = place[beyond] - own
            place[beyond] = here
            beyond = beyond[(here >= 0) & (on < last[beyond])]
        steps.append((active, edge, np.where(share > 0.5, lat.rest[node], 1 - share)))
        taken[active] += 1
        span = lat.span[edge]
        more = np.flatnonzero(span < _LAST)
        active, node, noise = active[more], node[more] + span[more], noise[more] + _STEP
    out = _Descent()
    # the s-th step of a word lies s places behind its first, so paths need no sort
    begin = np.cumsum(taken) - taken
    out.edge, rest = np.empty(int(taken.sum()), np.int64), np.empty(int(taken.sum()))
    for s, (occ, edge, other) in enumerate(steps):
        at = begin[occ] + s
        out.edge[at], rest[at] = edge, other
    out.noise = np.repeat(word - begin.astype(np.uint64) * _STEP, taken) + np.arange(len(out.edge), dtype=np.uint64) * _STEP
    out.doc, out.step_unit = np.repeat(occ_doc, taken), np.repeat(occ_unit, taken)
    sums = np.concatenate(([0], np.cumsum(_logs(lat, out.edge))))
    out.step_at = np.searchsorted(out.doc, np.arange(len(seed) + 1))
    out.phi = (phi - sums[out.step_at[:-1]] / _UNITS)[out.doc] + sums[:-1] / _UNITS
    out.total = phi + (sums[out.step_at[1:]] - sums[out.step_at[:-1]]) / _UNITS
    # edges are exponential times over their shares, the first one wins: given it, the first of the others comes later by a time over their common share, and over the probability of the way to their node
    with np.errstate(divide="ignore"):
        out.late = np.log(np.maximum(_exponential(_mix(out.noise + _NOISE)), 1e-300) / rest) - out.phi
    out.value, out.taken = value, {}
    return out


def sample_segmentations(texts: list[str], keys: np.ndarray, k: int, lat: Lattices) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct segmentations, best perturbed value first: ``(ids, log-probability, inclusion score)``.

    The log-probability is that of the segmentation among all of the text's.  The inclusion score is the probability that its perturbed value passes that of the
    best one left out (1 if none is), so that sums weighted by probability / inclusion are unbiased.
    """
    if lat.nodes > KEPT_NODES:
        lat.thin()
    words, which, sizes = _cut(texts)
    nodes = lat.add(words)[which]
    seed = _mix(keys.astype(np.int64).view(np.uint64) + _U(0x632BE59BD9B4E019))
    length, place = np.cumsum([len(t) for t in texts]), np.append(0, np.cumsum(sizes))
    out: list[list[tuple[np.ndarray, float, float]]] = []
    while len(out) < len(texts):
        a = len(out)
        b = max(a + 1, int(np.searchsorted(length, (length[a - 1] if a else 0) + _PART, side="right")))
        out += _sample(nodes[place[a] : place[b]], sizes[a:b], seed[a:b], k, lat)
    return out


def _sample(occ_node: np.ndarray, sizes: np.ndarray, seed: np.ndarray, k: int, lat: Lattices) -> list[list[tuple[np.ndarray, float, float]]]:
    """What ``sample_segmentations`` gives, for texts of ``sizes`` words whose first nodes lie end to end."""
    n = len(sizes)
    occ_doc = np.repeat(np.arange(n), sizes)
    first_occ = np.cumsum(sizes) - sizes
    occ_unit = np.arange(len(occ_node)) - first_occ[occ_doc]
    value, phi = -np.log(_exponential(_mix(seed + _U(1)))), np.zeros(n)
    descents: list[_Descent] = []
    paths: list[list[np.ndarray | None]] = []
    prefix: list[np.ndarray] = []
    out: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n)]
    live = np.ones(n, bool)
    begin, d_phi, head = occ_node, phi, [np.empty(0, np.int64)] * n
    use = np.ones(len(occ_node), bool)
    for s in range(k):
        d = _descend(lat, seed, s + 2, value, d_phi, occ_doc[use], occ_unit[use], begin[use])
        descents.append(d)
        prefix.append(np.array([len(h) for h in head]))
        here: list[np.ndarray | None] = [None] * n
        for i in np.flatnonzero(live).tolist():
            here[i] = np.concatenate((head[i], d.edge[d.step_at[i] : d.step_at[i + 1]]))
            out[i].append((here[i], float(d.total[i])))
        paths.append(here)
        # the best open node of each text over all descents
        best, best_of, best_at = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j, x in enumerate(descents):
            least, step = x.first_open(n)
            top = -np.logaddexp(-x.value, least)
            better = np.flatnonzero(top > best)
            best_at[better], best_of[better], best[better] = step[better], j, top[better]
        if s == k - 1:
            break
        live = np.isfinite(best)
        value = np.where(live, best, 0.0)
        d_phi = np.zeros(n)
        begin = occ_node.copy()
        use = np.zeros(len(occ_node), bool)
        head = [np.empty(0, np.int64)] * n
        for i in np.flatnonzero(live).tolist():
            x, step = descents[best_of[i]], int(best_at[i])
            edge, node = x.take(lat, step)
            d_phi[i] = x.phi[step] + _logs(lat, np.array([edge]))[0] / _UNITS
            within = prefix[best_of[i]][i] + step - x.step_at[i]
            head[i] = np.append(paths[best_of[i]][i][:within], edge)
            unit = first_occ[i] + x.step_unit[step]
            use[unit : first_occ[i] + sizes[i]] = True
            begin[unit] = node
    return [[(_ids(lat, edges), total, float(-np.expm1(-np.exp(min(total - best[i], 700.0)))) if np.isfinite(best[i]) else 1.0) for edges, total in found] for i, found in enumerate(out)]


def _ids(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    ids = lat.piece[edges]
    bare = np.flatnonzero(ids >= _ESCAPED)
    if not len(bare):
        return ids
    parts, last = [], 0
    for at in bare.tolist():
        parts.append(ids[last:at])
        parts.append(lat.vocab.byte_id[np.frombuffer(lat.escaped[ids[at] - _ESCAPED], np.uint8)])
        last = at + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32)


def encode_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """``(id, sample, ids, n_ids, log_prob, inclusion, round_trip)``: a row for each of up to ``k`` distinct segmentations of each row of ``docs``.

    ``sample`` counts from 0 by falling perturbed value; ``round_trip`` tells whether decoding gives the text again.  Null and empty texts have one empty
    segmentation.  Noise is seeded by the hash of the id and the text, so repeated rows have equal samples.  Very long texts are segmented whole, in
    time that grows with their length (much more of it where a text has no spaces).  Segmentations of equal perturbed value keep the order in which the search has met them, which is the same for
    equal rows.  An empty table gives an empty result; other columns are ignored.
    """
    source = clean_name(docs, id_col, text_col).toDF("id", "text").select("id", "text", F.xxhash64("id", "text").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        # they end with the task: the worker lives on, for other stages too
        lat = Lattices(vocab)
        for batch in batches:
            for part in slabs(batch, "text", _SLAB):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = sample_segmentations(texts, part.column(2).to_numpy(), k, lat)
                n = np.array([len(f) for f in found])
                rows = [x for f in found for x in f]
                ids = [x[0] for x in rows]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids).astype(np.int32)
                expected = [f" {t}".encode() if t else b"" for t, f in zip(texts, found, strict=True) for _ in f]
                good = list(map(eq, vocab.decoded(flat, sizes), expected))
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), n))),
                        pa.array(np.concatenate([np.arange(c) for c in n]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat)),
                        pa.array(sizes),
                        pa.array([x[1] for x in rows], pa.float64()),
                        pa.array([x[2] for x in rows], pa.float64()),
                        pa.array(good, pa.bool_()),
                    ],
                    ["id", "sample", "ids", "n_ids", "log_prob", "inclusion", "round_trip"],
                )

    kind = source.schema["id"].dataType.simpleString()
    out = map_arrow(source, run, f"id {kind}, sample int, ids array<int>, n_ids long, log_prob double, inclusion double, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of its ids as a last column ``decoded``; null ids decode to null."""
    names = [*rows.columns, "decoded"]
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else vocab.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names)

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
