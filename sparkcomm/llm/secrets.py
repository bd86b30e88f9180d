"""Secret scans: Boolean trigram queries against an inverted index choose candidates, regular expressions verify them."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcomm.llm.common import row_key
from sparkcomm.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    either_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return ("(?i)" if self.either_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", False, 0, 18),
    Rule("hex", "[0-9a-f]+", False, 0, 16),
)
MORE = (
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

#: Alternatives a rule may have, and characters of a class that are written out; beyond these, less is known of a match.
ALTERNATIVES, CLASS = 1_024, 8
_GAP = None
#: Size of the map that tells rows without a candidate's key apart.
BITS = 1 << 22


def _texts(parts) -> set[tuple]:
    """What a part of a pattern may match: tuples of strings that follow each other, with gaps of unknown text."""
    out: set[tuple] = {()}
    for op, arg in parts:
        if op is sre.LITERAL:
            new = {(chr(arg),)}
        elif op is sre.IN:
            plain = [chr(a) for o, a in arg if o is sre.LITERAL]
            new = {(c,) for c in plain} if len(plain) == len(arg) <= CLASS else {(_GAP,)}
        elif op is sre.SUBPATTERN:
            new = _texts(arg[3])
        elif op is sre.BRANCH:
            new = set().union(*(_texts(b) for b in arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = _texts(sub)
            if low == 0:
                new = {(), *inner} if high == 1 else {(_GAP,)}
            else:
                new = {t if high == 1 else (*t, _GAP) for t in inner}
        elif op is sre.AT:
            new = {()}
        else:
            new = {(_GAP,)}
        out = {a + b for a in out for b in new}
        if len(out) > ALTERNATIVES:
            return {(_GAP,)}
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Lower-case trigrams that each match must hold: one of the lists, all of its trigrams. None if a match may have none."""
    clauses = set()
    for text in _texts(parser.parse(pattern)):
        runs = "".join("\0" if t is _GAP else t for t in text).lower().split("\0")
        clauses.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in clauses:
        return None
    return sorted(sorted(c) for c in clauses if not any(other < c for other in clauses))


def index(docs: DataFrame, trigrams: list[str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the inverted index: trigram, and the document as (_k, _h: key as text, hash of the text)."""
    held = docs.select(*row_key(key, text), F.lower(F.col(text)).alias("_low"))
    there = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return held.select("_k", "_h", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], *, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """_k, _h, rules (numbers): documents whose postings meet a clause of the rule's query. None if no rule has a query."""
    queries = [(i, j, t, len(clause)) for i, r in enumerate(rules) for j, clause in enumerate(trigram_query(r.pattern) or []) for t in clause]
    if not queries:
        return None
    spark = docs.sparkSession
    postings = index(docs, sorted({t for _, _, t, _ in queries}), key=key, text=text).distinct()
    asked = spark.createDataFrame(queries, "rule int, clause int, trigram string, n int")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("_k", "_h", "rule", "clause").agg(F.count("*").alias("found"), F.first("n").alias("n"))
    return met.where("found = n").groupBy("_k", "_h").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """(kind, start, end) of a rule's matches in code points, end exclusive: lengths of the matches and of what lies between them, added up."""

    def spans(found: Column) -> Column:
        def walk(a: Column, m: Column) -> Column:
            start = a["at"] + m["gap"]
            span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + m["size"]).alias("end"))
            return F.struct((start + m["size"]).alias("at"), F.when(m["kept"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), walk, lambda a: a["out"])

    pattern = F.lit(rule.java)
    gaps = F.transform(F.split(text, rule.java, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    inner = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    # zip ends with the last gap, which no match follows
    found = F.filter(F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("size"), inner.alias("kept")), lambda z: z), lambda z: z["size"].isNotNull())
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(text.rlike(_sieve(rule)), spans(found)).otherwise(none)


def _sieve(rule: Rule) -> str:
    """A pattern that every kept match contains; a run of one class is asked for at its least length."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1:
        head = rule.pattern.split("[")[0]
        return rule.java[:-1] + "{" + str(rule.least - len(head)) + ",}"
    return rule.java


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """Key, text, spans: (kind, start, end) of all rules by start, then rule. ``carry`` gives the whole row as the struct ``row`` in place of key and text.

    Matches of a rule are leftmost and do not overlap; those of too few characters are dropped. Rules of which every match holds known
    trigrams are run on the candidates of the index only, the others on all texts. Null texts count as empty.
    """
    found = candidates(docs, rules, key=key, text=text)
    rows = docs.select(*row_key(key, text), F.struct("*").alias("row") if carry else F.struct(F.col(key), F.col(text)).alias("row"))
    if found is not None:
        found = materialize(found)
        marked = _marked(found)
        met = rows.where(marked).join(found.hint("merge"), ["_k", "_h"], "left")
        rows = met.unionByName(rows.where(~marked).withColumn("rules", F.lit(None).cast("array<int>")))
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    spans = []
    for i, r in enumerate(rules):
        chosen = F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains("rules", i), F.lit(False))
        spans.append(_ranked(F.when(chosen, matches(t, r)), i))
    spans = [F.coalesce(s, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")) for s in spans]
    every = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = rows.select("row", every.alias("spans"))
    return out if carry else out.select("row.*", "spans")


def _marked(found: DataFrame) -> Column:
    """Whether a row may be a candidate, by a bit map of hashed keys (512 KB): true for all candidates and, by chance, for some others.

    Only these rows meet the candidates by shuffle; the texts of the others stay where they are. A full map costs a shuffle of all, not a match.
    """
    spot = F.xxhash64("_k", "_h").bitwiseAND(BITS - 1)
    at = found.groupBy(F.shiftright(spot, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))).alias("bits"))
    table = [0] * (BITS // 64)
    for r in at.collect():  # a row per word of the map
        table[r["at"]] = r["bits"]
    words = F.from_json(F.lit(str(table)), "array<bigint>")
    return F.getbit(F.element_at(words, F.shiftright(spot, 6).cast("int") + 1), spot.bitwiseAND(63).cast("int")) == 1


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """The text with each span replaced by its kind; spans that begin inside an earlier one are part of it."""

    def walk(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        name = F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))
        new = F.struct(F.concat(a["out"], before, name).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= a["at"], new).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, walk, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
