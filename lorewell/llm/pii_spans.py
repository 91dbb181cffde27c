"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Fixed patterns give the base spans, which always stay, and wider patterns give more candidates (failed base matches
   and national formats).
2. Labelers vote on every candidate for, against or not at all: a format check, a gazetteer (domain endings, card prefixes,
   country codes, reserved networks), a context labeler (cue words before the span) and a shape labeler (monotone digits).
3. The votes are counted by (kind, vote pattern); expectation-maximisation on these counts estimates how each labeler votes on
   true and false spans and each kind's share of true ones.
4. A logistic classifier over discrete span features is fitted to the resulting probabilities, weighted by counts.
   Both tables are bounded by the number of kinds, patterns and feature values, whatever the corpus.
5. Candidates beyond the base become spans if the classifier gives at least one half.

Places are code points, end exclusive. Edge cases: NULL and empty texts have no spans; no candidates at all give no
model and no added spans; repeated rows and NULL ids are rows like any other; other columns are not looked at.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import per_text
from lorewell.session import materialize

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ip_like", "card_like", "phone_like", "ssn", "iban"]
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin with the first digit of a run, so the test before it changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_WORD = re.compile(r"[a-z]+")

# What the gazetteer and context labelers know.
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "mx"}
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "2")
COUNTRY_CODES = ("+1", "+33", "+34", "+44", "+49", "+39", "+31", "+52", "+54", "+55", "+81", "+86", "+91")
RESERVED = ("10.", "127.", "0.", "192.168.", "169.254.", "255.")
CUES = ["mail", "email", "contact", "write", "tel", "phone", "call", "mobile", "fax", "card", "visa", "mastercard",
        "credit", "account", "iban", "bank", "ssn", "security", "ip", "host", "address", "from", "login"]
AGAINST = ["version", "release", "isbn", "order", "invoice", "article", "page", "section", "chapter", "id", "number"]
N_CUES = len(CUES) + 1

LABELERS = ["format", "gazetteer", "context", "shape"]
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid_ip(span: str) -> bool:
    parts = [p.lstrip("0") for p in span.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str):
    """Matches of local@domain: the longest local part before each @, from the end of the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        done = at + 1  # no local part reaches back over an @
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", done)


def _mod_97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def candidates(text: str, has_at: bool, has_digit: bool) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base spans and further candidates."""
    out = []
    if has_at:
        out += [("email", a, b) for a, b in _emails(text)]
    if has_digit:
        for m in _IP.finditer(text):
            out.append(("ip" if valid_ip(m[0]) else "ip_like", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19:
                out.append(("card" if luhn(d) else "card_like", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_digits(m[0]))
                if 7 <= n <= 17:
                    out.append(("phone" if 9 <= n <= 15 else "phone_like", *m.span()))
        out += [("phone_like", *m.span()) for m in _NATIONAL.finditer(text)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    return out


def _context(text: str, start: int) -> tuple[int, int]:
    """(vote, cue): the nearest cue word among the three words before the span, counted from 1; 0 for none."""
    before = _WORD.findall(text[max(0, start - 48) : start].lower())[-3:]
    for word in reversed(before):
        if word in CUES:
            return 1, CUES.index(word) + 1
        if word in AGAINST:
            return -1, 0
    return 0, 0


def votes(kind: str, span: str, text: str, start: int) -> tuple[list[int], int]:
    """One vote per labeler (1 for, -1 against, 0 none), and the cue."""
    digits = _digits(span)
    if kind == "email":
        ending = span.rpartition(".")[2].lower()
        form = 1 if ending.isalpha() and len(ending) >= 2 else -1
        known = 1 if ending in ENDINGS else 0
    elif kind in ("ip", "ip_like"):
        form = 1 if kind == "ip" else -1
        known = -1 if span.startswith(RESERVED) else 0
    elif kind in ("card", "card_like"):
        form = 1 if kind == "card" else -1
        known = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind == "iban":
        form, known = (1 if _mod_97(span) else -1), 0
    elif kind == "ssn":
        form, known = (-1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1), 0
    else:
        form = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if span.startswith(COUNTRY_CODES) else 0
    context, cue = _context(text, start)
    if len(digits) < 4:
        shape = 0
    else:
        steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])}
        shape = -1 if len(steps) == 1 else (1 if len(set(digits)) >= 4 else 0)
    return [form, known, context, shape], cue


def _pattern(ballot: list[int]) -> int:
    out = 0
    for v in ballot:
        out = out * 3 + v + 1
    return out


def features(kind: str, span: str, text: str, start: int, end: int, cue: int) -> int:
    """The discrete features as one number: kind, length class, how it is bounded, and the cue."""
    length = min(len(span).bit_length(), 6)
    bounded = (start == 0 or text[start - 1].isspace()) + 2 * (end == len(text) or text[end].isspace() or text[end] in ",.;)")
    return ((RANK[kind] * 7 + length) * 4 + bounded) * N_CUES + cue


N_FEATURES = len(KINDS) * 7 * 4 * N_CUES

SPANS = "array<struct<rank:int,start:bigint,end:bigint,pattern:int,feature:int>>"


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, with all `candidates` and their votes."""
    kind = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32()), ("feature", pa.int32())])

    def step(texts: pa.Array) -> list:
        at, digit = pc.match_substring(texts, "@"), pc.match_substring_regex(texts, "[0-9]")
        out: list[list] = [[] for _ in range(len(texts))]
        at, digit = at.to_numpy(zero_copy_only=False), digit.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(at | digit).tolist():
            body = texts[i].as_py()
            for name, start, end in sorted(set(candidates(body, at[i], digit[i])), key=lambda c: (RANK[c[0]], c[1])):
                span = body[start:end]
                ballot, cue = votes(name, span, body, start)
                out[i].append((RANK[name], start, end, _pattern(ballot), features(name, span, body, start, end, cue)))
        fields = ("rank", "start", "end", "pattern", "feature")
        return [pa.array([[dict(zip(fields, s)) for s in row] for row in out], pa.list_(kind))]

    return per_text(docs, text, step, f"candidates {SPANS}", keep)


def estimate(rank: np.ndarray, pattern: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: (probability of each row being true, vote shares [labeler, class, vote]).

    Labelers vote independently given the truth; they start as mostly right, which settles which class is the true one.
    """
    ballots = np.array(list(product(range(3), repeat=len(LABELERS))))[pattern]
    share = np.tile([[0.5, 0.35, 0.15], [0.15, 0.35, 0.5]], (len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), 0.5)
    truth = np.zeros(len(n))
    for _ in range(rounds):
        log = np.stack((np.log1p(-prior[rank]), np.log(prior[rank])), axis=1)
        for k in range(len(LABELERS)):
            log += np.log(share[k][:, ballots[:, k]]).T
        truth = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        held = np.stack((1 - truth, truth)) * n
        for k in range(len(LABELERS)):
            for c in (0, 1):
                count = np.bincount(ballots[:, k], held[c], 3) + np.array([[5, 3, 2], [2, 3, 5]][c])
                share[k, c] = count / count.sum()
        prior = (np.bincount(rank, held[1], len(KINDS)) + 1) / (np.bincount(rank, n, len(KINDS)) + 2)
    return truth, share


def _one_hot(feature: np.ndarray) -> np.ndarray:
    """Indicator columns of kind, length class, bounds and cue."""
    cue, rest = feature % N_CUES, feature // N_CUES
    bounded, rest = rest % 4, rest // 4
    length, rank = rest % 7, rest // 7
    sizes, parts = (len(KINDS), 7, 4, N_CUES), (rank, length, bounded, cue)
    out = np.zeros((len(feature), sum(sizes) + 1))
    out[:, -1] = 1
    base = 0
    for size, part in zip(sizes, parts):
        out[np.arange(len(feature)), base + part] = 1
        base += size
    return out


def fit_classifier(feature: np.ndarray, truth: np.ndarray, n: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    x = _one_hot(feature)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (truth - p)) - w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(found: DataFrame) -> np.ndarray | None:
    """Probability by feature number, or None without candidates; from counts by (pattern, feature)."""
    each = found.select(F.explode("candidates").alias("c")).select("c.rank", "c.pattern", "c.feature")
    counts = each.groupBy("rank", "pattern", "feature").agg(F.count(F.lit(1)).alias("n")).toPandas()  # bounded by its keys
    if not len(counts):
        return None
    counts = counts.sort_values(["rank", "pattern", "feature"])
    rank, pattern, feature, n = (counts[c].to_numpy() for c in ("rank", "pattern", "feature", "n"))
    truth, _ = estimate(rank, pattern, n.astype(float))
    w = fit_classifier(feature, truth, n.astype(float))
    return 1 / (1 + np.exp(-np.clip(_one_hot(np.arange(N_FEATURES)) @ w, -30, 30)))


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, with `spans`: the base and what the classifier adds."""
    found = materialize(find(docs, text, keep), "pii-candidates")
    likely = fit(found)
    beyond = np.arange(N_FEATURES) >= len(BASE_KINDS) * (N_FEATURES // len(KINDS))
    added = np.flatnonzero(beyond & (likely >= threshold)) if likely is not None else []
    accepted = F.array(*[F.lit(int(f)) for f in added]).cast("array<int>")  # at most one entry per feature number

    def stays(c: Column) -> Column:
        return (c["rank"] < len(BASE_KINDS)) | F.array_contains(accepted, c["feature"])

    return found.select("row", F.filter("candidates", stays).alias("spans"))


def spans_text(listed: Column) -> Column:
    """kind:start:end by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(listed, lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", names[c["rank"]], c["start"], c["end"])), ",")
