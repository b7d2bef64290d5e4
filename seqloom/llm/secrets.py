"""Secret scan: keyword automaton, anchored patterns near its hits, then checksums.

One Aho-Corasick pass over the lower-cased text finds keywords and provider prefixes; a second pass over the text
with every lower-case hex digit folded to one symbol finds runs of sixteen of them.  Regular expressions then run anchored, only
at hits.  Kinds that embed a checksum or fixed structure (payment cards, bank accounts, CRC-32 tokens) are kept only if it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm._store import clean_name, map_arrow

#: The base kinds, in the order in which they are listed.
BASE = ("assign", "access", "hex")
#: The kinds that the method adds, after the base ones.
EXTRA = ("card", "iban", "crc_token", "jwt", "private_key")
KINDS = BASE + EXTRA

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}", re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", re.ASCII)
_CRC = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.ASCII)
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", re.ASCII)
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
_PEM_BEGIN = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", re.ASCII)
_PEM_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.ASCII)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Characters of a bank account by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}

#: Keyword -> the kind whose pattern is tried where it begins.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "crc_token"),
    "eyj": "jwt",
    "-----begin ": "private_key",
    "-----end ": "private_key_end",
}
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Digits and hex letters fold to class symbols; what breaks a run of them folds to a blank.
_FOLD_HEX = {**dict.fromkeys(map(ord, "0123456789abcdef"), "h"), ord("h"): "."}
_FOLD_ID = {**dict.fromkeys(map(ord, "0123456789"), "d"), **dict.fromkeys(range(65, 91), "c"), ord("c"): ".", ord("d"): "."}
_HEX_RUN = 16


def _automaton(words: dict[str, object]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, value in words.items():
        made.add_word(word, (len(word), value))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def crc_ok(body: str, check: str) -> bool:
    n = zlib.crc32(body.encode())
    out = ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out == check


def card_end(text: str, start: int) -> int:
    """End of the longest card number from ``start`` that ends where no digit follows and whose checksum holds; 0 without one."""
    m = _CARD.match(text, start)
    if not m:
        return 0
    end = m.end()
    digits = re.sub("[ -]", "", m[0])
    while len(digits) >= 13:
        if not text[end : end + 1].isdigit() and luhn(digits):
            return end
        digits, end = digits[:-1], end - 1
        while not text[end - 1].isdigit():
            end -= 1
    return 0


def iban_end(text: str, start: int) -> int:
    """End of the bank account from ``start``: the whole run, or as much of it as the country has, if the checksum holds; 0 without one."""
    m = _IBAN.match(text, start)
    if not m:
        return 0
    own = IBAN_LENGTHS.get(m[0][:2], len(m[0]))
    return next((start + n for n in (len(m[0]), own) if n <= len(m[0]) and iban_ok(m[0][:n])), 0)


class Scanner:
    """Finds spans ``(start, end, kind number)`` in code points, sorted by start, then kind."""

    def __init__(self) -> None:
        self.words = _automaton(KEYWORDS)
        self.hex_runs = _automaton({"h" * _HEX_RUN: "hex"})
        # four digits begin every card number; two capitals and two digits every bank account
        self.ids = _automaton({"dddd": "card", "ccdd": "iban"})

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        after = dict.fromkeys([*KINDS, "private_key_end"], 0)
        # the first key that has begun and not ended: its start, and where its body begins
        begun: tuple[int, int] | None = None

        def keep(kind: str, start: int, end: int) -> None:
            found.append((start, end, KINDS.index(kind)))

        for end, (size, kind) in self.words.iter(text.translate(_LOWER)):
            start = end - size + 1
            if start < after[kind]:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, start):
                    after[kind] = m.end()
                    if len(m[2]) >= 12:
                        keep(kind, start, m.end())
            elif kind == "access":
                if m := _ACCESS.match(text, start):
                    after[kind] = m.end()
                    if m.end() - start >= 18:
                        keep(kind, start, m.end())
            elif kind == "crc_token":
                if (m := _CRC.match(text, start)) and crc_ok(m[1], m[2]):
                    after[kind] = m.end()
                    keep(kind, start, m.end())
            elif kind == "jwt":
                if m := _JWT.match(text, start):
                    after[kind] = m.end()
                    keep(kind, start, m.end())
                else:
                    # what follows the run decides, so it decides for all that begin in it
                    after[kind] = _JWT_RUN.match(text, start).end()
            elif kind == "private_key":
                if begun is None and (m := _PEM_BEGIN.match(text, start)):
                    begun = (start, m.end())
            elif begun and start > begun[1] and (m := _PEM_END.match(text, start)):
                after["private_key"] = m.end()
                keep("private_key", begun[0], m.end())
                begun = None
        for end, (size, kind) in self.hex_runs.iter(text.translate(_FOLD_HEX)):
            start = end - size + 1
            if start >= after[kind]:
                # the automaton reports a run's first sixteen digits first, so the match is leftmost and maximal
                stop = _HEX.match(text, start).end()
                after[kind] = stop
                keep(kind, start, stop)
        for end, (size, kind) in self.ids.iter(text.translate(_FOLD_ID)):
            start = end - size + 1
            if start < after[kind] or text[start - 1 : start].isalnum():
                continue
            if stop := card_end(text, start) if kind == "card" else iban_end(text, start):
                after[kind] = stop
                keep(kind, start, stop)
        return sorted(found, key=lambda s: (s[0], s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``, one row per row of ``docs``: an array of ``(kind, start, end)`` in code points, end exclusive.

    Null and empty texts have no spans.  Repeated rows each give a row, an empty table none; other columns are ignored.
    Very long texts are scanned whole, in time that grows with their length.  Spans that start together are listed in the order of ``KINDS``.
    Matches of one kind never overlap (leftmost first); matches of different kinds may.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(kind))], ["id", "spans"])

    source = clean_name(docs, id_col, text_col).toDF("id", "text")
    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mask``; all other columns and all rows stay as they are.

    Overlapping or touching spans become one mask.  Null texts stay null, empty ones empty; very long texts are masked whole; repeated rows stay; an empty table gives an empty result.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        at = names.index(text_col)
        for batch in batches:
            out = []
            for cell in batch.column(at):
                text = cell.as_py()
                spans = scan.spans(text) if text else []
                if spans:
                    parts, last = [], 0
                    merged: list[list[int]] = []
                    for s, e, _ in spans:
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        parts += [text[last:s], mask]
                        last = e
                    text = "".join([*parts, text[last:]])
                out.append(text)
            columns = [pa.array(out, batch.schema.types[at]) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch(columns, names)

    return docs.mapInArrow(run, docs.schema)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text, per row of ``docs``.

    Null, empty and very long texts, repeated rows, spans that start together, empty tables and other columns as in ``scan_secrets``; a null id stays null.
    """
    from pyspark.sql import functions as F

    spans = scan_secrets(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def listed(array: F.Column) -> F.Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        F.col("id").alias(id_col),
        *[count(k) for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

