"""Anchor expansion: Aho-Corasick finds cheap anchors, local parsers grow them into personal data.

One automaton over the whole text finds at-signs, schemes, plus signs, digits and identifier
cues. Around each anchor a deterministic parser expands to the boundaries of an email, an IP or web
address, a card, phone or account number, and validates it. Text without an anchor costs one
linear pass.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import blocks, col

#: Base kinds in their fixed order, then the kinds that anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "password", "passwd", "secret", "token", "api_key", "api-key", "apikey",
        "ssn", "customer id", "user id")

_DIGIT = frozenset("0123456789")
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _LETTER | _DIGIT | set("._%+-")
_LABEL = _LETTER | _DIGIT | {"-"}
_PHONE = _DIGIT | set(" ().-")
_ID = _LETTER | _DIGIT | set("_-+/=")
_URL_END = frozenset(" \t\n\r\v\f<>\"'`{}|\\^")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in _DIGIT:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def _run(text: str, i: int, chars) -> int:
    """End of the run of ``chars`` that begins at ``i``."""
    while i < len(text) and text[i] in chars:
        i += 1
    return i


def emails(text: str, at: list[int]) -> list[tuple[int, int]]:
    """Local part leftwards to the end of the match before, then labels with at least one dot."""
    out, done = [], 0
    for p in at:
        s = p
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        e = _run(text, p + 1, _LABEL)
        if s == p or e == p + 1:
            continue
        dots = 0
        while e + 1 < len(text) and text[e] == "." and text[e + 1] in _LABEL:
            e, dots = _run(text, e + 1, _LABEL), dots + 1
        if dots:
            out.append((s, e))
            done = e
    return out


def _chains(text: str, runs: list[tuple[int, int]], joints: str) -> list[list[tuple[int, int]]]:
    """Neighbouring digit runs joined by exactly one of ``joints``."""
    out: list = []
    for r in runs:
        if out and r[0] == out[-1][-1][1] + 1 and text[r[0] - 1] in joints:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def addresses(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Fours of dotted numbers, leftmost first; a four with a part above 255 is dropped."""
    out = []
    for chain in _chains(text, runs, "."):
        for i in range(0, len(chain) - 3, 4):
            four = chain[i:i + 4]
            if all(len(p := text[s:e].lstrip("0")) <= 3 and int(p or "0") <= 255 for s, e in four):
                out.append((four[0][0], four[-1][1]))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for chain in _chains(text, runs, " -"):
        if 14 <= sum(e - s for s, e in chain) <= 19 and luhn("".join(text[s:e] for s, e in chain)):
            out.append((chain[0][0], chain[-1][1]))
    return out


def phones(text: str, plus: list[int]) -> list[tuple[int, int]]:
    out, done = [], 0
    for p in plus:
        if p < done or p + 1 >= len(text) or text[p + 1] not in _DIGIT:
            continue
        e = _run(text, p + 2, _PHONE)
        while e > p + 3 and text[e - 1] not in _DIGIT:
            e -= 1
        if e <= p + 3 or text[e - 1] not in _DIGIT:
            continue
        done = e
        if 10 <= sum(c in _DIGIT for c in text[p:e]) <= 15:
            out.append((p, e))
    return out


def urls(text: str, schemes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Scheme to the next blank or quote, without closing marks; the host needs a dot inside."""
    out, done = [], 0
    for s, e in schemes:
        if s < done or (s and text[s - 1] in _LETTER):
            continue
        z = e
        while z < len(text) and text[z] not in _URL_END:
            z += 1
        while z > e and text[z - 1] in ".,;:!?)]":
            z -= 1
        host = text[e:z].split("/", 1)[0]
        if "." in host.strip("."):
            out.append((s, z))
            done = z
    return out


def accounts(text: str, cues: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """After a cue: at most three blanks or quotes, a ``:``, ``=`` or ``#``, the same again, an identifier with two digits."""
    out, done = [], 0
    for s, e in cues:
        if s < done or (s and text[s - 1] in _LETTER):
            continue
        j = e
        while j < len(text) and j < e + 3 and text[j] in " \"'":
            j += 1
        if j >= len(text) or text[j] not in ":=#":
            continue
        k = j + 1
        while k < len(text) and k < j + 4 and text[k] in " \"'":
            k += 1
        z = _run(text, k, _ID)
        while z > k and text[z - 1] in "-+/=":
            z -= 1
        if z - k >= 6 and sum(c in _DIGIT for c in text[k:z]) >= 2:
            out.append((k, z))
            done = z
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, by start, then by the order of kinds."""
    anchors: dict[str, list] = {"digit": [], "at": [], "plus": [], "scheme": [], "cue": []}
    for last, (kind, n) in automaton().iter(text):
        anchors[kind].append((last - n + 1, last + 1))
    runs: list = []
    for s, e in anchors["digit"]:
        if runs and runs[-1][1] == s:
            runs[-1] = (runs[-1][0], e)
        else:
            runs.append((s, e))
    found = {"email": emails(text, [s for s, _ in anchors["at"]]), "ip": addresses(text, runs),
             "card": cards(text, runs), "phone": phones(text, [s for s, _ in anchors["plus"]]),
             "url": urls(text, anchors["scheme"]), "account": accounts(text, anchors["cue"])}
    return [(s, e, k) for s, _, e, k in sorted((s, i, e, k) for i, k in enumerate(KINDS) for s, e in found[k])]


def _digest(spans, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256, spans), one row per input row.

    Whole texts; null and empty texts have no spans (the checksum of an empty string). Null ids
    and repeated rows keep their rows; other columns are not read. Map-only.
    """

    def run(batches):
        for batch, texts in blocks(batches):
            spans = [find(t) for t in texts.to_pylist()]
            counts = [pa.array(np.array([sum(k == kind for _, _, k in s) for s in spans], np.int64)) for kind in KINDS]
            base = [hashlib.sha256(_digest(s, BASE_KINDS).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base), pa.array([_digest(s, KINDS) for s in spans])],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return (docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string"))
