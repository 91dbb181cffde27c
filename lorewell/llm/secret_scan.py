"""Secret scans by a trigram inverted index; DataFrame functions only.

1. Each rule's regular expression gives a Boolean trigram query (`trigrams.trigram_query`).
2. `index` writes the postings: (trigram, text) for the trigrams that the rules ask for. A text stands for all rows that
   hold it and is named by two 64-bit hashes.
3. `candidates` joins postings with the trigram sets of the rules and keeps (set, text) pairs with a posting for every
   trigram of the set: the intersection of postings, one row per hit, without lists.
4. `scan` verifies: the texts get their candidate rules (a join whose small side Spark broadcasts below its size
   threshold, else shuffled with a runtime filter), and only those rules are run. Rules without mandatory
   trigrams run on every text.

Places are in code points, end exclusive: the lengths of the pieces between matches and of the matches are
summed. Matches are leftmost and do not overlap within a rule; a match whose group is too short is dropped.

Edge cases: a NULL text is empty and has no spans; repeated rows and NULL ids give rows like any other; other columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.trigrams import trigram_query
from lorewell.session import materialize


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base patterns and their limits. Where a match is one run of characters, its least length is part of the pattern:
# shorter runs hold no match and end where the next one may begin, so the spans are the same.
BASE_RULES = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Further formats of published token kinds.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = [*BASE_RULES, *MORE_RULES]
MARK = "[SECRET]"

#: Matches whose places are summed in one go.
CHUNK = 512
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def queries(rules: list[Rule]) -> dict[int, list[list[str]]]:
    """By place of the rule, its sets of trigrams; rules to be scanned fully are absent."""
    found = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    return {i: sorted(sorted(s) for s in q) for i, q in found.items() if q is not None}


def _named(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias("row"), body.alias("text"), F.xxhash64(body).alias("k1"),
                       F.xxhash64(F.lit("second"), body).alias("k2"))


def index(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Postings (trigram, k1, k2) of the trigrams that the rules ask for."""
    grams = sorted({g for sets in queries(rules).values() for s in sets for g in s})
    low = _named(docs, text, []).select(F.lower("text").alias("low"), "k1", "k2")
    # one bit per trigram first: these comparisons compile to one loop over the rows
    masks = []
    for k in range(0, len(grams), 60):
        mask = F.lit(0).cast("bigint")
        for i, g in enumerate(grams[k : k + 60]):
            mask = mask.bitwiseOR(F.when(F.contains("low", F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)))
        masks.append(mask.alias(f"m{k // 60}"))
    marked = low.select("k1", "k2", *masks)
    def present(k: int) -> Column:
        entries = [
            F.struct(F.lit(g).alias("trigram"), F.lit(1 << i).cast("bigint").alias("bit"))
            for i, g in enumerate(grams[k : k + 60])
        ]
        return F.filter(F.array(*entries), lambda e: e["bit"].bitwiseAND(F.col(f"m{k // 60}")) != 0)

    names = [present(k) for k in range(0, len(grams), 60)]
    if not names:
        return marked.select(F.lit("").alias("trigram"), "k1", "k2").limit(0)
    return marked.select("k1", "k2", F.explode(F.concat(*names)).alias("e")).select("e.trigram", "k1", "k2")


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(k1, k2, rules): the bits of the rules whose trigram query the text meets.

    Postings meet the sets of trigrams (a fixed list) and are intersected per (set, text): the bits of the trigrams found
    are or-ed before the shuffle, so that copies of a text cost one row per task.
    """
    entries = [
        (set_no, rule, gram, 1 << i, (1 << len(grams)) - 1)
        for set_no, (rule, grams) in enumerate((r, s) for r, sets in queries(rules).items() for s in sets)
        for i, gram in enumerate(grams[:60])
    ]
    spark = postings.sparkSession
    terms = spark.createDataFrame(
        [(s, 1 << r, g, b, a if a < 2**60 else 2**60 - 1) for s, r, g, b, a in entries],
        "set_no int, rule bigint, trigram string, bit bigint, every bigint",
    )
    met = postings.join(F.broadcast(terms), "trigram")
    whole = met.groupBy("k1", "k2", "set_no", "rule", "every").agg(F.bit_or("bit").alias("found"))
    return whole.filter("found = every").groupBy("k1", "k2").agg(F.bit_or("rule").alias("rules"))


def _pieces(rule: Rule, text: Column) -> Column:
    """Per match: characters before it since the last match, of the match, and of the checked group."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    return F.arrays_zip(gaps.alias("gap"), whole.alias("match"), part.alias("part"))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """The spans of one rule in a text.

    Places are running sums over the matches. They are summed in chunks, so that very many matches stay near linear.
    """
    none = F.array().cast(f"array<{SPAN}>")
    sizes = F.transform(
        F.filter(_pieces(rule, text), lambda p: p["match"].isNotNull()),
        lambda p: F.struct(
            F.char_length(p["gap"]).alias("gap"), F.char_length(p["match"]).alias("match"),
            F.char_length(p["part"]).alias("part"),
        ),
    )

    def span(start, end):
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def add(state, s):
        start = state["at"] + s["gap"]
        end = start + s["match"]
        longer = F.when(s["part"] >= rule.least, F.concat(state["out"], F.array(span(start, end))))
        return F.struct(end.alias("at"), longer.otherwise(state["out"]).alias("out"))

    def chunks(z):
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(z, k * CHUNK + 1, CHUNK), begin, add))

    def place(done):
        def moved(c, k):
            base = F.aggregate(F.slice(done, 1, k), F.lit(0), lambda a, d: a + d["at"])
            return _let(base, lambda b: F.transform(c["out"], lambda s: span(s["start"] + b, s["end"] + b)))

        return F.flatten(F.transform(done, moved))

    return _let(sizes, lambda z: F.when(F.size(z) > 0, _let(chunks(z), place)).otherwise(none))


def _redacted(rule: Rule, text: Column) -> Column:
    """The text with the rule's matches replaced by the mark."""
    marked = F.transform(
        F.filter(_pieces(rule, text), lambda p: p["gap"].isNotNull()),
        lambda p: F.concat(
            p["gap"],
            F.when(p["match"].isNull(), "")
            .when(F.char_length(p["part"]) >= rule.least, MARK)
            .otherwise(p["match"]),
        ),
    )
    return F.array_join(marked, "")


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns `keep`) as struct `row`, `text`, the bits `rules` to run, and the `spans`.

    Spans are (start, rank, end, kind) in the order of start and rule.
    """
    postings = materialize(index(docs, text, rules), "secret-postings")
    wanted = materialize(candidates(postings, rules), "secret-candidates")
    full = sum(1 << i for i in range(len(rules)) if i not in queries(rules))
    named = _named(docs, text, docs.columns if keep is None else keep)
    joined = named.join(wanted, ["k1", "k2"], "left").withColumn(
        "rules", F.coalesce("rules", F.lit(0).cast("bigint")).bitwiseOR(F.lit(full))
    )
    found = []
    for rank, rule in enumerate(rules):
        asked = F.col("rules").bitwiseAND(F.lit(1 << rank)) != 0
        if rule.group == 0 and full >> rank & 1:
            asked = asked & F.rlike("text", F.lit(rule.pattern))
        found.append(F.when(asked, _spans(rule, rank, F.col("text"))).otherwise(F.array().cast(f"array<{SPAN}>")))
    return joined.select("row", "text", "rules", F.array_sort(F.concat(*found)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", rules: list[Rule] = RULES) -> DataFrame:
    """The documents with every secret replaced by a mark, and the column `length` set to the new number of characters.

    Rules apply one after the other to what is left of the text, so that overlapping secrets give one mark.
    """
    def step(rank: int, rule: Rule):
        asked = F.exists("spans", lambda s: s["rank"] == rank)
        return lambda b: F.when(asked, _redacted(rule, b)).otherwise(b)

    body = F.col("text")
    for rank, rule in enumerate(rules):
        body = _let(body, step(rank, rule))
    clean = F.when(F.size("spans") > 0, body)
    found = scan(docs, text, rules).withColumn("clean", clean)
    columns = []
    for name in docs.columns:
        old = F.col(f"row.`{name}`")
        if name == text:
            old = F.coalesce("clean", old)
        elif name == length:
            old = F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(docs.schema[name].dataType)).otherwise(old)
        columns.append(old.alias(name))
    return found.select(*columns)
