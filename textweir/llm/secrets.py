"""Secrets: patterns, and assignments whose targets have telling names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
LEAST = 0.75

# Texts are scanned as UTF-8; `low` has A-Z in lower case, byte for byte.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

#: Names that have one of these can be sensitive; texts without any need no lexing.
STEMS = re.compile(rb"pass|pwd|secret|token|key|credential|auth|bearer|private|salt")
STRONG = frozenset({"password", "passwd", "passphrase", "pwd", "secret", "secrets", "token", "apikey", "credential", "credentials", "bearer"})
WEAK = frozenset({"pass", "auth", "private", "salt"})
KEY_OF = frozenset({"api", "access", "private", "secret", "signing", "encryption", "auth", "account", "master", "storage"})
#: Names that end so hold something about a secret, not the secret.
ABOUT = frozenset("name url uri path file dir field length size policy type id header prompt label hint regex pattern expires expiry ttl count limit endpoint env var help title description".split())
DUMMY = re.compile(rb"(?i)change.?me|example|placeholder|dummy|redacted|your[_-]|^(?:null|none|nil|true|false|undefined|string|todo)$|^[<\[{(].*[>\]})]$|^(.)\1*$|^\*+$|\$\{|\{\{|%\(|%s")

# A name with closing quotes and brackets, perhaps a declared type, and the sign of an assignment.
TARGET = re.compile(rb"""(?<![\w.$-])([A-Za-z_$][\w.$-]*+)["'\]]*+[ \t]*+(?::[ \t]*+[A-Za-z_][\w\[\], |.]*+(?==))?(?:=>|:=|[=:])(?![=:])""")
STRING = rb"""[rRbBuUfF@]{0,2}+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`)"""
# A literal, a constant by name, or what stands bare in settings; not a call.
TERM = re.compile(rb"[ \t]*+(?:\n\s*+(?=[\"'`]))?(?:" + STRING + rb"|\$\{?([A-Za-z_]\w*+)\}?|([^\s\"'`,;(){}\[\]<>&|=]++(?:=++(?![^\s\"',;)}]))?)(?![(\[]))")
MORE = re.compile(rb"[ \t]*+\\?\n?[ \t]*+\+[ \t]*+\\?\n?")
NAME = re.compile(rb"[A-Za-z_$][\w.$]*+\Z")
ELEMENT = re.compile(rb"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</\1>")
FLAG = re.compile(rb"(?<!\S)--([A-Za-z][\w-]*+)[ \t]++([^\s\"'`-][^\s\"'`]*+)")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Found(NamedTuple):
    start: int
    kind: int
    end: int
    name: str
    score: float


class Definition(NamedTuple):
    """`name` is given literals (start, end) and the values of other names."""

    name: bytes
    at: int
    literals: list[tuple[int, int]]
    uses: list[bytes]
    bare: bool


@lru_cache(10_000)
def name_score(name: bytes) -> float:
    parts = [p.lower() for p in PARTS.findall(name.decode("utf-8", "replace"))]
    if not parts or parts[-1] in ABOUT:
        return 0.0
    pairs = {a + b for a, b in zip(parts, parts[1:])}
    if not STRONG.isdisjoint(parts) or not STRONG.isdisjoint(pairs) or parts[-1] in ("key", "keys") and not KEY_OF.isdisjoint(parts):
        return 0.6
    return 0.4 if not WEAK.isdisjoint(parts) else 0.0


def literal_score(value: bytes, bare: bool) -> float:
    """What a literal adds to its name: length, kinds of characters, entropy; -1 for stand-ins."""
    if len(value) < 6 or DUMMY.search(value):
        return -1.0
    kinds = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^\sA-Za-z0-9]"))
    if bare and kinds < 2:
        return -1.0
    n = np.bincount(np.frombuffer(value, np.uint8))
    entropy = sum(-x / len(value) * log2(x / len(value)) for x in n[n > 0].tolist())
    return 0.1 * (len(value) >= 8) + 0.1 * (kinds >= 2) + 0.1 * (kinds >= 3) + 0.2 * (kinds >= 2 and entropy >= 3) - 0.4 * bool(re.search(rb"\s", value)) - 0.3 * value.startswith((b"/", b"http:", b"https:"))


def definitions(text: bytes) -> list[Definition]:
    """Names and what they are given, in order: assignments, settings, elements and flags."""
    out = []
    for m in TARGET.finditer(text):
        literals, uses, bare, at = [], [], False, m.end()
        while term := TERM.match(text, at):
            quoted = next((g for g in (1, 2, 3) if term.start(g) >= 0), 0)
            if quoted:
                literals.append(term.span(quoted))
            elif term.start(4) >= 0:
                uses.append(term[4])
            else:
                if NAME.match(term[5]):
                    uses.append(term[5])
                literals.append(term.span(5))
                bare = True
            more = MORE.match(text, term.end())
            if not more:
                break
            at = more.end()
        if literals or uses:
            out.append(Definition(m[1], m.start(), literals, uses, bare))
    for pattern in (ELEMENT, FLAG):
        out += [Definition(m[1], m.start(), [m.span(2)], [], True) for m in pattern.finditer(text)]
    return sorted(out, key=lambda d: d.at)


def literals_of(text: bytes) -> list[Found]:
    """Literals whose score with the most telling name that they reach is LEAST or more.

    A name that is used stands for its definition before the use, else for the first after it, so
    names flow back from each definition to those it uses, from the most telling name on.
    """
    every = definitions(text)
    scores = [name_score(d.name) for d in every]
    if not any(scores):
        return []
    held: dict[bytes, int] = {}
    source: list[list[int | None]] = []
    for i, d in enumerate(every):
        source.append([held.get(u) for u in d.uses])
        held[d.name] = i
    first = {d.name: i for i, d in reversed(list(enumerate(every)))}
    best: dict[int, tuple[float, bytes]] = {}
    for i in sorted((i for i, s in enumerate(scores) if s), key=lambda i: -scores[i]):
        todo = [i]
        while todo:
            at = todo.pop()
            if at in best:
                continue
            best[at] = scores[i], every[i].name
            todo += [s if s is not None else first[u] for s, u in zip(source[at], every[at].uses) if s is not None or u in first]
    out: dict[tuple[int, int], Found] = {}
    for i, (telling, name) in best.items():
        d = every[i]
        # A bare word that names a constant is no literal.
        literals = [(s, e) for s, e in d.literals if not (d.bare and text[s:e] in first)]
        if not literals:
            continue
        score = round(telling + literal_score(b"".join(text[s:e] for s, e in literals), d.bare), 3)
        if score >= LEAST:
            for span in literals:
                if span[1] > span[0] and (span not in out or out[span].score < score):
                    out[span] = Found(span[0], KINDS.index("literal"), span[1], name.decode("utf-8", "replace"), score)
    return list(out.values())


def secrets_of(text: str) -> list[Found]:
    """All spans of a text by start and kind, in code points."""
    data = text.encode()
    low = data.lower()
    found = [Found(m.start(), 0, m.end(), "", 1.0) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 6]
    found += [Found(m.start(), kind, m.end(), "", 1.0) for kind, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(data)]
    if STEMS.search(low):
        found += literals_of(data)
    if found and len(data) != len(text):
        place = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        at = lambda b: int(place[b - 1]) if b else 0
        found = [f._replace(start=at(f.start), end=at(f.end)) for f in found]
    return sorted(found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets) of every row: array of (kind, start, end, value, name, score) by start and kind.

    Kinds assign, access and hex come from patterns, score 1. Kind literal: the text is lexed for
    names that are given literals (assignments, settings, elements, flags, also in comments);
    constants carry the names of what they are assigned to; the most telling name and the look of
    the literal make its score. A null text counts as empty; texts are scanned whole; null ids and
    rows that repeat give a row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                out.append([{"kind": KINDS[f.kind], "start": f.start, "end": f.end, "value": text[f.start : f.end], "name": f.name, "score": f.score} for f in secrets_of(text)])
            yield pd.DataFrame({"id": batch["id"], "secrets": out})

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, secrets array<struct<kind:string,start:int,end:int,value:string,name:string,score:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def listed(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    kept = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
