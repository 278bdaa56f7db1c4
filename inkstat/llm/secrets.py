"""Secret scan: Aho-Corasick keywords, regular expressions anchored at their hits, embedded checksums.

One pass of the automaton over the text, with A-Z lower-cased, finds all places where a keyword
stands; only there the expression of its kind is tried, at that very place. Within a kind matches
are leftmost and do not overlap, and a match that fails its length or checksum is dropped but
still covers its text. ``hex`` has no keyword; its runs are found by length alone.

Checksums: GitHub and npm tokens end in the base-62 CRC-32 of what stands before, a JSON web token
has a header that decodes to an object with ``alg``, a private key is a DER sequence of the length
that it states.

Nulls: a null text is empty; a row without doc_id is scanned like any other. The time follows the
length of a text. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstat.llm.scratch import small_batches

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(m: re.Match) -> bool:
    """Six base-62 digits at the end are the CRC-32 of the part between the prefix and them."""
    body = m[0].partition("_")[2]
    value = 0
    for c in body[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:-6].encode())


def web_token(m: re.Match) -> bool:
    head = m[0].partition(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


def private_key(m: re.Match) -> bool:
    try:
        der = base64.b64decode("".join(m[1].split()), validate=True)
    except binascii.Error:
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    size = der[1] & 0x7F
    if der[1] < 0x80:
        return len(der) == 2 + size
    return len(der) == 2 + size + int.from_bytes(der[2 : 2 + size], "big")


# fixed values: kind, keywords, expression that begins with the keyword, test of a match
KINDS: tuple[tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool]], ...] = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 12),
    ("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_token),
    ("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_token),
    ("jwt", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"), web_token),
    ("pem", ("-----begin",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----"), private_key),
)
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
ORDER = {kind: i for i, kind in enumerate((*BASE_KINDS, "github", "npm", "jwt", "pem"))}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for number, (_, keywords, _, _) in enumerate(KINDS):
        for word in keywords:
            out.add_word(word, (number, len(word)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """A-Z in lower case and every other character as it is, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def find_secrets(text: str, keywords: ahocorasick.Automaton) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    hits: dict[int, list[int]] = {}
    for last, (number, size) in keywords.iter(lowered(text)):
        hits.setdefault(number, []).append(last - size + 1)
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    for number, places in hits.items():
        kind, _, expression, holds = KINDS[number]
        free = 0
        for at in sorted(places):
            if at >= free and (m := expression.match(text, at)):
                free = m.end()
                if holds(m):
                    found.append((kind, *m.span()))
    return sorted(found, key=lambda f: (f[1], ORDER[f[0]]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, findings), one row per row of ``docs(doc_id, text)``; a finding has kind, start, end and the text found."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def rows(batches):
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find_secrets(t, keywords)] for t in (t or "" for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "findings"])

    return docs.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, findings array<struct<kind:string,start:long,end:long,value:string>>")
