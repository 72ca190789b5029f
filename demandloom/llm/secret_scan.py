"""Secret scan: fixed patterns, and literals that flow into names which call for secrecy.

The lexer reads assignments of source and configuration text as pairs of a name and a value: ``name
= value``, ``name: value`` (also with a quoted name or a type), ``name := value``, ``name =>
value``, ``setName("value")``, ``put("name", "value")`` and ``<name>value</name>``. A value is a
chain of literals and names joined by ``+``; a name stands for what it was last given. The
assignments make a graph whose edges lead back to earlier ones, so the most sensitive name that each
gets to is found in one pass from the last to the first, and a constant is followed to where it is
used at a cost linear in the text. Each literal is scored by that name and by its own look.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and the lengths below which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be left out at once
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "literal")
#: Without one of these no pattern of the first kind matches.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: How sensitive the words of a name are, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "passcode": 0.9, "secret": 0.9, "secrets": 0.8, "token": 0.8,
    "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.6,
}
#: Words that make a key sensitive when they stand before it.
KEY_KINDS = {
    "api", "private", "access", "secret", "signing", "encryption", "auth", "master", "service", "account", "shared", "ssh", "client", "session",
    "storage", "webhook", "deploy", "hmac", "aes", "rsa",
}
#: Words that tell of something about a secret rather than the secret.
ABOUT = {
    "count", "length", "len", "max", "min", "id", "name", "type", "url", "uri", "path", "file", "hint", "label", "field", "regex",
    "policy", "expires", "expiry", "ttl", "age", "limit", "limits", "size", "prompt", "placeholder", "title", "text", "index", "error",
}
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "signature")
THRESHOLD = 0.5
#: Names of this score keep a value that reads as prose: a passphrase is made of words.
STRONG = 0.9
MIN_LITERAL = 6

NAME = r"[A-Za-z_$][\w$.\-]*"
TARGET = re.compile(
    rf"""(?<![\w$.\-])(?P<name>{NAME})["']?\]?(?:[ \t]*:[ \t]*[A-Za-z_][\w.<>\[\]|?]*(?=[ \t]*=))?[ \t]*(?::=|=>|=(?![=>~])|:(?![:=/]))[ \t]*""", re.ASCII
)
PUT = re.compile(rf"""(?<![\w$\-])(?:put|set\w*|add\w*|define|header|config)\([ \t]*["'](?P<name>{NAME})["'][ \t]*,[ \t]*""", re.ASCII)
CALL = re.compile(rf"""(?<![\w$.\-])(?P<name>{NAME})\([ \t]*(?=["'A-Za-z_$])""", re.ASCII)
ELEMENT = re.compile(rf"<(?P<name>{NAME})>(?P<value>[^<>\n]+)</", re.ASCII)
STRING = re.compile(r"""[bruf]?(?:"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`)""", re.ASCII)
TRIPLE = re.compile(r"""[bruf]?("{3}|'{3})""", re.ASCII)
WORD = re.compile(rf"{NAME}(?![\w$(/+=@%])", re.ASCII)
#: Where a word that stands for a value ends; before anything else it is the beginning of the value.
END = re.compile(r"[ \t]*(?:[\r\n,;)\]}+]|\Z|(?<=[ \t])(?:#|//))")
BARE = re.compile(r"""(?:[^\s,;'"()\[\]{}<>&|`]|&(?![\w.%\-]+=))+""")
LINE_START = re.compile(r"[ \t]*(?:(?:export|set|env|-)[ \t]+)*", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?:[^\s&]|&(?![\w.%\-]+=))+")
REST = re.compile(r"[ \t]+[^\n]+")
COMMENT = re.compile(r"[ \t](?:#|//)")
#: A line of words that is a value rather than a sentence.
PHRASE = re.compile(r"[a-z]+(?:[ \t]+[a-z]+){2,11}")
KEYWORDS = re.compile(r"\b(?:if|else|or|not|await|new)\b")
CODE = re.compile(r"[A-Za-z_][A-Za-z_.]*[(\[]", re.ASCII)
BEGIN_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
END_KEY = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
PLUS = re.compile(r"[ \t]*\+[ \t]*")
PLACEHOLDER = re.compile(
    r"^(?:[xX*.\-_#?]+|\$\{.*|\{\{.*|%.*%|<.*|(?:your|my|the|some|an?)[\s_-].*|(?:change|replace|insert|example|dummy|sample|placeholder|redacted).*|none|null|true|false|undefined|string)$", re.IGNORECASE
)
PEM = re.compile(r"\s*-----BEGIN [A-Z0-9 ]+-----")
SCHEME = re.compile(r"\s*(?:bearer|basic|token|apikey|negotiate|ntlm)[ \t]+(?=\S)", re.IGNORECASE | re.ASCII)
#: A word of a sentence, with its quotes and marks.
PROSE = re.compile(r"""["'(]?[^\W\d_]*(?:['\u2019-][^\W\d_]+)*[)"']?[.,;:!?]?["')]?$""")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Span:
    """Code points from ``start`` up to ``end``; ``name`` and ``score`` are the method's reasons."""

    kind: str
    start: int
    end: int
    name: str | None = None
    score: float | None = None


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlap within a kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How sensitive a name is, by its words in any spelling (a_b, a-b, a.b, aB)."""
    words = [w.lower() for w in PARTS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for before, word in zip(words, words[1:], strict=False):
        if word in ("key", "keys") and before in KEY_KINDS:
            best = max(best, 0.9)
        if before == "pass" and word in ("word", "phrase", "code"):
            best = max(best, 1.0)
    if words and words[-1] == "pass":
        best = max(best, 0.8)
    return best * 0.3 if words and words[-1] in ABOUT else best


def value_score(value: str, weight: float = 1.0) -> float:
    """How much a literal looks like a secret: not short, no placeholder, varied characters.

    A private key's header and what follows an authentication scheme count by themselves. Other
    values with blanks score as their best part without one; those that read as prose score little,
    unless ``weight``, the score of the name, is that of a name which can only hold a secret.
    """
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value):
        return 0.0
    if header := PEM.match(value):
        return 1.0 if "PRIVATE" in header[0] else 0.0
    if scheme := SCHEME.match(value):
        return value_score(value[scheme.end() :].strip(), weight)
    parts = value.split()
    if len(parts) > 1:
        if all(PROSE.match(x) for x in parts):
            return 0.7 if weight >= STRONG and len(value) >= 16 else 0.4
        return max(value_score(x, weight) for x in parts)
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    if entropy < 1.5:
        return 0.2
    kinds = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), any(not c.isalnum() for c in counts)))
    if kinds == 1 and not value.isdigit():
        return 0.7 if len(value) >= 16 else 0.55
    return 1.0


class Unquoted:
    """Reads values without quotes. The run of a value is kept, as the next assignment may begin inside it."""

    def __init__(self, text: str):
        self.text = text
        self.run = (0, 0)
        self.key_end: tuple[int, int] = (-1, -1)  # from where an end was looked for, and where it begins or the text's end

    def end_of_key(self, at: int) -> int:
        """Where the private key whose header ends at ``at`` ends; each end is looked for once."""
        if not self.key_end[0] <= at <= self.key_end[1]:
            end = END_KEY.search(self.text, at)
            self.key_end = (at, end.start() if end else len(self.text))
        end = END_KEY.match(self.text, self.key_end[1])
        return end.end() if end else at

    def read(self, at: int, name_at: int) -> tuple[int, int] | None:
        """The range of the value at ``at`` of a name that begins at ``name_at``; None for code.

        After a name at the start of a line it is what a configuration file takes: all up to a
        blank, and further blank-free parts that are no words of prose; a line of lower-case words
        under a sensitive name is a passphrase. Elsewhere brackets, quotes, commas and the ``&`` of
        a query string end it too. An authentication scheme before it is left out.
        """
        text = self.text
        if key := BEGIN_KEY.match(text, at):
            return at, self.end_of_key(key.end())
        if scheme := SCHEME.match(text, at):
            at = scheme.end()
        if CODE.match(text, at):
            return None
        if not self.run[0] <= at < self.run[1]:
            line = text.rfind("\n", max(0, name_at - 200), name_at) + 1
            own_line = (line or name_at <= 200) and LINE_START.fullmatch(text, line, name_at)
            m = (TOKEN if own_line else BARE).match(text, at)
            if not m:
                return None
            self.run = m.span()
            if own_line:
                end = at + len(m[0].rstrip(",;"))
                more = REST.match(text, m.end())
                if more and (rest := COMMENT.split(more[0], maxsplit=1)[0].rstrip()):
                    if PHRASE.fullmatch(text[at : m.end()] + rest) and not KEYWORDS.search(rest):
                        end = m.end() + len(rest)
                    elif not PROSE.match(m[0]):
                        for part in re.finditer(r"\S+", rest):
                            if not PROSE.match(part[0]):
                                end = m.end() + part.end()
                end -= (text[end - 1] in ")]}" and not any(c in text[at:end] for c in "([{")) if end > at else 0
                self.run = (at, end)
        return (at, self.run[1]) if at < self.run[1] else None


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literal ranges, names referred to) of each assignment, in the order of the text."""
    found = [(m.end(), m["name"], False, m.start()) for m in TARGET.finditer(text)]
    found += [(m.end(), m["name"], True, m.start()) for pattern in (PUT, CALL) for m in pattern.finditer(text)]
    found += [(m.start("value"), m["name"], None, m.start()) for m in ELEMENT.finditer(text)]
    unquoted = Unquoted(text)
    for at, name, called, start in sorted(found, key=lambda f: f[0]):
        if called is None:
            end = text.find("<", at)
            yield name, [(at, end)], []
            continue
        literals, references = [], []
        while True:
            if (m := TRIPLE.match(text, at)) and (end := text.find(m[1], m.end())) >= 0:
                literals.append((m.end(), end))
                at = end + 3
                if not (plus := PLUS.match(text, at)):
                    break
                at = plus.end()
                continue
            if m := STRING.match(text, at):
                literals.append(m.span(m.lastindex))
            elif m := WORD.match(text, at):
                if not called and not literals and not references:
                    literals_if_unknown = m.span()
                    if not END.match(text, m.end()):
                        literals_if_unknown = unquoted.read(at, start)
                        if literals_if_unknown != m.span():  # the word is only the beginning of a value
                            literals += [literals_if_unknown] if literals_if_unknown else []
                            break
                references.append(m[0])
            else:
                if not called and not literals and not references and (r := unquoted.read(at, start)):
                    literals.append(r)
                break
            plus = PLUS.match(text, m.end())
            if not plus:
                break
            at = plus.end()
        if not called and len(references) == 1 and not literals:
            yield name, [literals_if_unknown], references
        else:
            yield name, literals, references


def literal_spans(text: str) -> list[Span]:
    """Literals that a sensitive name gets, directly or by way of constants."""
    lower = text.lower()
    if not any(h in lower for h in HINTS):
        return []
    last: dict[str, int] = {}  # the newest assignment to each name
    made: list[tuple[list[tuple[int, int]], set[int]]] = []
    weights: list[tuple[float, int]] = []  # the best name score, and minus the assignment that has it
    names: list[str] = []
    for name, literals, references in pairs(text):
        used = {last[r] for r in references if r in last}
        if used and len(literals) == 1 and text[slice(*literals[0])] == references[0]:
            literals = []  # the word is a constant's name, not a value
        last[name] = len(made)
        weights.append((name_score(name), -len(made)))
        names.append(name)
        made.append((literals, used))
    for i in range(len(made) - 1, -1, -1):
        for j in made[i][1]:
            weights[j] = max(weights[j], weights[i])
    found: list[Span] = []
    told, weak = (0, 0), (0, 0)  # the last ranges that were found and not; what is assigned inside one is a part of it
    for (literals, _), (weight, by) in zip(made, weights, strict=True):
        if weight < THRESHOLD:
            continue
        for r in literals:
            if told[0] <= r[0] and r[1] <= told[1] or weak[0] <= r[0] and r[1] == weak[1] and 2 * (r[1] - r[0]) > weak[1] - weak[0]:
                continue
            score = weight * value_score(text[slice(*r)], weight)
            if score >= THRESHOLD:
                found.append(Span("literal", *r, names[-by], round(score, 3)))
                told = r
            else:
                weak = r
    return sorted(found, key=lambda s: (s.start, s.end))


def scan(text: str) -> list[Span]:
    """All spans by start, then by kind; literals wholly inside one match of a pattern are not told twice."""
    base = base_spans(text)
    more = [s for s in literal_spans(text) if not any(b.start <= s.start and s.end <= b.end for b in base)]
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])
)
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row, each text scanned whole.

    Null and empty texts have no spans. Rows are scanned one by one, so repeated rows, ties and
    null ids change nothing. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[vars(s) for s in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS_ARROW)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, mark: str) -> str:
    """The text with its spans, joined where they overlap, replaced by the mark."""
    out, at = [], 0
    for s in scan(text):
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The input rows, all of them and with all columns, with the secrets in the text replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else redacted(t, mark) for t in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(1)], names=["text", "row"])

    text_type = docs.schema[text_col].dataType.simpleString()
    row_type = docs.select(F.struct("*").alias("row")).schema["row"].dataType
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("row", row_type)])
    light = docs.select(F.col(text_col).cast("string").alias("text"), F.struct("*").withField(text_col, F.lit(None).cast(text_type)).alias("row"))
    done = light.mapInArrow(run, schema)
    return done.select(*[(F.col("text").cast(text_type) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)
