"""Secret scanning with an assignment-aware lexer.

Three base patterns are always reported: ``assign`` (a sensitive word, a separator and a
value), ``access`` (cloud key ids) and ``hex`` (long hexadecimal runs).  Beside them the lexer
reads source and configuration syntax into name-literal pairs: ``name = "x"``, ``name: x``,
``"name": "x"``, ``export NAME=x``, ``name := x``, ``name => x``, ``<name>x</name>``,
``.put("name", "x")``, triple-quoted and back-quoted literals over several lines, indented blocks
after ``name: |``, and private keys in armour.  A pair whose value is a bare name is resolved through the other pairs
(constant propagation, transitively, cycles cut): through the last one before it that
assigns the name, or else the first one after it.  Adjacent literals joined by ``+`` are one value.  A literal is
scored by how sensitive its target names are (its own and those it is propagated to) and by its
shape: length, character classes, entropy, and whether it is a placeholder.  Literals that reach
the threshold add a ``pair`` span.

The base patterns' spans never change.  Each text is scanned whole, in time linear in its length; the
scan is a map without shuffle.

Defined results: null texts are empty and stay null when redacted; positions are code points, ends
exclusive; a span is that of the whole match for base kinds and of the literal for ``pair``; base
kinds may overlap each other; of spans with one start the kind listed first comes first; repeated rows and rows that share
an id each have their own result; very long texts, names and literals have no bound; an empty table gives no row;
columns that are carried along may have any name but those that are made, which is refused.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "pair")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run that fails is dropped whole, so asking for the least length at once is the same.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Names and literals may have any length.  What may follow a run is never in its class, so runs
#: give nothing back (possessive) and a text is read in linear time.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A triple or back quote runs to the next one; an opening without one can only be the text's last.
_LITERAL = "(?:" + "|".join(
    [rf"{q * 3}(?P<{g}>(?:[^\\{q}]|\\[\s\S]|{q}(?!{q * 2}))*+){q * 3}" for q, g in (('"', "double3"), ("'", "single3"))]
    + [rf"{q}(?P<{g}>(?!{q})[^\\\n{q}]*+(?:\\.[^\\\n{q}]*+)*+){q}" for q, g in (('"', "double"), ("'", "single"))]
    + [r"`(?P<back>[^`]++)`"]
) + ")"
_QUOTED = ("double3", "single3", "double", "single", "back")
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?(?P<name>{_NAME})["']?[ \t]*(?::[ \t]*(?:[A-Za-z]+[ \t]*)?=|=>|:=|[:=])(?!=)[ \t]*(?:{_LITERAL}|(?P<bare>[^\s,;"'`<>()\[\]{{}}]++))""")
_CALL = re.compile(rf"""\(\s*["'](?P<name>{_NAME})["']\s*,\s*{_LITERAL}""")
_TAG = re.compile(rf"""<(?P<name>{_NAME})>(?P<bare>[^<>\s]++)</""")
#: A name, a block mark, and the lines below that are indented or empty.
_BLOCK = re.compile(rf"""(?<![A-Za-z0-9_.\-])["']?(?P<name>{_NAME})["']?[ \t]*:[ \t]*[|>][+\-]?[0-9]?[ \t]*\n(?P<block>[ \t]+[^\n]*+(?:\n(?:[ \t]+[^\n]*+|(?=\n)))*+)""")
_ARMOUR = re.compile(r"-----BEGIN (?P<name>[A-Z ]*PRIVATE KEY[A-Z ]*)-----(?P<block>(?:[^-]|-(?!----(?:BEGIN|END) ))++)-----END ")
_MORE = re.compile(rf"""[ \t]*\+[ \t]*{_LITERAL}""")
_IDENTIFIER = re.compile(rf"{_NAME}$")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Sensitivity of a name's parts (fixed values).
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "signing": 0.5, "encryption": 0.5, "access": 0.4, "key": 0.4, "api": 0.4, "client": 0.2, "salt": 0.5, "session": 0.4}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%|\{\{.*\}\}|your[_\-]?.*|example.*|changeme|placeholder|none|null|true|false|todo|redacted)$", re.I)
THRESHOLD = 1.2
MADE = ["n_assign", "n_access", "n_hex", "n_pair", "base_sha256", "spans", "redacted"]


def sensitivity(name: str) -> float:
    """Sum of the parts' weights, capped at 1.4; ``apiKey``, ``API_KEY`` and ``api-key`` are alike."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.4, sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined}))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def shape(value: str) -> float:
    """How much a literal looks generated: 0 for words and placeholders, up to 1."""
    if len(value) < 8 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * (classes - 1) + 0.1 * max(0.0, entropy(value) - 2) + 0.01 * min(len(value), 40))


def solid(value: str) -> str:
    """A literal of several lines as one run, if its lines have no spaces inside."""
    return "".join(line.strip() for line in value.splitlines()) if "\n" in value else value


def _quoted(m: re.Match) -> str | None:
    """Which group holds the quoted literal of a match, if any."""
    groups = m.groupdict()
    return next((g for g in _QUOTED if groups.get(g) is not None), None)


def pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """Name, value, span of the value and whether it is a bare word, in order."""
    found = []
    for pattern in (_PAIR, _CALL, _TAG):
        for m in pattern.finditer(text):
            if group := _quoted(m):
                values, start, end = [m[group]], m.start(group), m.end(group)
                more = _MORE.match(text, m.end())
                while more:  # "abc" + "def"
                    group = _quoted(more)
                    values.append(more[group])
                    end = more.end(group)
                    more = _MORE.match(text, more.end())
                found.append((m["name"], "".join(values), start, end, False))
            else:
                value = m["bare"].rstrip(".")
                if value not in ("|", ">"):
                    found.append((m["name"], value, m.start("bare"), m.start("bare") + len(value), True))
    for pattern in (_BLOCK, _ARMOUR):
        for m in pattern.finditer(text):
            body = m["block"]
            start = m.start("block") + len(body) - len(body.lstrip())
            found.append((m["name"], body.strip(), start, start + len(body.strip()), False))
    return sorted(set(found), key=lambda p: (p[2], p[3], p[0]))


def _resolved(listed: list[tuple[str, str, int, int, bool]]) -> list[int]:
    """For each pair the one whose literal it stands for."""
    of_name: dict[str, list[int]] = {}
    for i, (name, *_) in enumerate(listed):
        of_name.setdefault(name, []).append(i)

    def target(i: int) -> int | None:
        """The pair that a bare name refers to."""
        name, value, _, _, bare = listed[i]
        if not bare or value == name or value not in of_name or not _IDENTIFIER.match(value):
            return None
        found = of_name[value]
        before = bisect.bisect_left(found, i)
        return found[before - 1] if before else found[0]

    stands: list[int] = [-1] * len(listed)
    for i in range(len(listed)):
        path, on = [], set()
        while stands[i] < 0:
            path.append(i)
            on.add(i)
            nxt = target(i)
            if nxt is None or nxt in on:  # a literal, or a cycle: cut here
                stands[i] = i
                break
            i = nxt
        for p in path:
            stands[p] = stands[i]
    return stands


def pair_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of literals whose names and shape reach the threshold."""
    if not any(c in text for c in "=:<(") and "PRIVATE KEY" not in text:
        return []
    listed = pairs(text)
    names: dict[tuple[int, int], set[str]] = {}
    values: dict[tuple[int, int], str] = {}
    for (name, *_), to in zip(listed, _resolved(listed), strict=True):
        _, value, start, end, _ = listed[to]
        names.setdefault((start, end), set()).add(name)
        values[start, end] = solid(value)
    return sorted(span for span, own in names.items() if (s := max(map(sensitivity, own))) > 0.5 and (looks := shape(values[span])) > 0 and s + looks >= threshold)


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start, then kind as listed."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found += [("pair", a, b) for a, b in pair_spans(text, threshold)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str | None:
    """``text`` with every stretch that a span covers replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_cols: list[str], text: str = "text", threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """``id_cols`` with counts, the base digest, all spans and, if asked, ``redacted`` text."""
    common.short_batches(docs.sparkSession)
    common.refuse(id_cols, [*MADE, "__text"])
    rows = docs.select(*id_cols, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    names = [f.name for f in fields]
    made = ["n_assign", "n_access", "n_hex", "n_pair", "base_sha256", "spans", *(["redacted"] if redact else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            spans = [scan(t, threshold) for t in texts]
            written = [[f"{k}:{a}:{b}" for k, a, b in s] for s in spans]
            base = [hashlib.sha256(",".join(w for w in ws if not w.startswith("pair:")).encode()).hexdigest() for ws in written]
            columns = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS]
            columns += [pa.array(base, pa.string()), pa.array([",".join(w) for w in written], pa.string())]
            if redact:
                columns.append(pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], names=[*names, *made])

    kinds = ["long"] * 4 + ["string"] * (2 + redact)
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} {k}" for n, k in zip(made, kinds, strict=True)]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, ["doc_id"]).drop("n_pair")
