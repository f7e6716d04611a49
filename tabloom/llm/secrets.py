"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regex yields a Boolean trigram query: an OR of alternatives, each
an AND of the trigrams that any match must hold. The index lists, for every
trigram that some query names, the documents whose folded text holds it;
intersecting the postings gives each rule's candidates, and the regex runs on
those alone. A rule with an alternative that has no trigram (such as a run of
hex digits) scans every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import bounded, stage

CLASS_EXPANSION = 8     # a character class of at most this many members counts as alternatives
CHUNK = 512             # positions are summed up in chunks of this many matches

# Private-use marks put around matches; in texts they are replaced one for one.
OPEN, CLOSE, MID, OTHER = "\ue000", "\ue001", "\ue002", "\ufffd"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match must have ``shortest`` characters, or its second group if ``grouped``."""

    kind: str
    regex: str
    shortest: int = 0
    grouped: bool = False


# Fixed values of the contract, then common token formats.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
         6, True),
    # Runs at their least length: a longest run is left alone exactly if it is too short, and marking
    # every shorter run would mark most words.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def _literals(seq) -> list[list[str]]:
    """Alternatives of mandatory literals, each a list whose last item may still grow."""
    out = [[""]]
    for op, arg in seq:
        if op is sre.LITERAL:
            out = [[*a[:-1], a[-1] + chr(arg)] for a in out]
        elif op is sre.SUBPATTERN:
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(out, _literals(arg[3]))]
        elif op is sre.BRANCH:
            branches = [b for branch in arg[1] for b in _literals(branch)]
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(out, branches)]
        elif (op is sre.IN and len(arg) <= CLASS_EXPANSION and all(x is sre.LITERAL for x, _ in arg)):
            out = [[*a[:-1], a[-1] + chr(c)] for a, (_, c) in product(out, arg)]
        elif op is sre.MAX_REPEAT and arg[0] >= 1 and all(x is sre.LITERAL for x, _ in arg[2]):
            text = "".join(chr(c) for _, c in arg[2]) * arg[0]
            out = [[*a[:-1], a[-1] + text, *([text[-2:]] if arg[1] != arg[0] else [])] for a in out]
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            out = [[*a, *b, ""] for a, b in product(out, _literals(arg[2]))]
        else:
            out = [[*a, ""] for a in out]
    return out


def trigram_query(regex: str) -> list[list[str]] | None:
    """OR of ANDs of folded trigrams that a match must hold; None if there is no such query."""
    found = []
    for literals in _literals(sre_parse.parse(regex)):
        grams = sorted({x.lower()[k:k + 3] for x in literals for k in range(len(x) - 2)})
        if not grams:
            return None
        found.append(grams)
    unique = sorted({tuple(x) for x in found})
    return [list(x) for x in unique if not any(set(y) < set(x) for y in unique)]


def trigram_postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(gram, id): one posting for each of ``grams`` that a document's folded text holds."""
    # The folded text is a column of its own: it is made once, not once for each gram.
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("id", F.explode(held).alias("gram")).filter("gram is not null")


def candidates(postings: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(id, kinds): the rules whose query the postings of a document satisfy.

    Postings meet by document id (rows that share an id share their postings,
    which can only add candidates), pre-aggregated where they were made.
    """
    held = postings.groupBy("id").agg(F.collect_set("gram").alias("grams"))

    def holds(query: list[list[str]]) -> Column:
        found = F.lit(False)
        for grams in query:
            found = found | (F.size(F.array_except(F.array(*map(F.lit, grams)), F.col("grams"))) == 0)
        return found
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return held.select("id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _running(part: Column, base: Column) -> Column:
    """base, base + part[0], base + part[0] + part[1], ...: one value per element of ``part``."""
    grown = F.aggregate(part, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(grown, 1, F.size(part))


def _marked(rule: Rule) -> Column:
    """The body with marks around the rule's matches; empty if the row is no candidate."""
    marks = f"{OPEN}$1{MID}$2{CLOSE}" if rule.grouped else f"{OPEN}$0{CLOSE}"
    marked = F.regexp_replace("clean", F.lit(rule.regex), F.lit(marks))
    if trigram_query(rule.regex) is None:
        return marked
    return F.when(F.array_contains("kinds", F.lit(rule.kind)), marked).otherwise(F.lit(""))


def add_spans(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """id and ``spans``: leftmost non-overlapping matches of each rule, in code points.

    Matches are marked in place; the text between the marks gives the
    lengths, and their running sums (in chunks, so that the cost stays near
    linear) the positions. Each step is a column of its own, so that nothing
    is computed twice.
    """
    n = range(len(rules))
    extra = [1 if r.grouped else 0 for r in rules]

    def found(k: int) -> Column:
        # Of each piece after the first: the match, what must be long enough, the whole step; without marks.
        return F.when(F.size(f"pieces{k}") > 1, F.transform(
            F.slice(f"pieces{k}", 2, F.greatest(F.size(f"pieces{k}") - 1, F.lit(1))), lambda p: F.struct(
                (F.length(F.substring_index(p, CLOSE, 1)) - extra[k]).alias("match"),
                F.length(F.substring_index(F.substring_index(p, CLOSE, 1), MID, -1)).alias("own"),
                (F.length(p) - 1 - extra[k]).cast("long").alias("step")))).otherwise(
            F.array().cast("array<struct<match:int,own:int,step:bigint>>"))

    def chunks(k: int) -> Column:
        last = F.greatest(F.ceil(F.size(f"found{k}") / F.lit(CHUNK)), F.lit(1)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.transform(
            F.slice(f"found{k}", c * F.lit(CHUNK) + 1, F.lit(CHUNK)), lambda f: f["step"]))

    def totals(k: int) -> Column:
        return F.transform(f"chunks{k}", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))

    def spans(k: int) -> Column:
        return F.array_compact(F.zip_with(f"found{k}", f"start{k}", lambda f, s: F.when(
            f["own"] >= rules[k].shortest, F.struct(s.alias("start"), F.lit(k).alias("rank"),
                                                    (s + f["match"]).alias("end"),
                                                    F.lit(rules[k].kind).alias("kind")))))

    df = df.select("id", "kinds", F.translate("body", OPEN + CLOSE + MID, OTHER * 3).alias("clean"))
    df = df.select("id", *[F.split(_marked(r), OPEN).alias(f"pieces{k}") for k, r in enumerate(rules)])
    df = df.select("id", *[F.length(F.col(f"pieces{k}")[0]).cast("long").alias(f"first{k}") for k in n],
                   *[found(k).alias(f"found{k}") for k in n])
    df = df.withColumns({f"chunks{k}": chunks(k) for k in n})
    df = df.withColumns({f"totals{k}": totals(k) for k in n})
    df = df.withColumns({f"base{k}": _running(F.col(f"totals{k}"), F.col(f"first{k}")) for k in n})
    df = df.withColumns({f"start{k}": F.flatten(F.zip_with(f"chunks{k}", f"base{k}", _running)) for k in n})
    return df.select("id", F.array_sort(F.concat(*[spans(k) for k in n])).alias("spans"))


def scan_secrets(docs: DataFrame, rules: list[Rule] = (*BASE, *MORE), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id and ``spans`` (start, rank, end, kind; sorted) of every row.

    A null text has no span; rows repeated with an id each get their own
    spans; rows with a null id are scanned like any other.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not None}
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    picked = stage(candidates(trigram_postings(docs, grams, id_col, text_col), queries), "secret-candidates")
    side = bounded(picked, picked.count(), 160)
    both = src.join(side, F.col("doc").eqNullSafe(F.col("id")), "left")
    return add_spans(both.select(F.col("doc").alias("id"), "body", "kinds"), list(rules))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(F.col("id").alias("doc_id"), *[count(r.kind) for r in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
