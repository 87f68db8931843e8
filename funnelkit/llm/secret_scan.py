"""Secret scan with multipart credential linking, DataFrame functions alone.

Base patterns report by themselves.  Weak candidates (identifiers, key-like
strings, endpoints) are reported only where parts that complete them lie in
reach: an identifier needs a secret, a secret an identifier or an endpoint, an
endpoint both.  In reach is what ends or begins within ``SCOPE`` code points of
a part, and all parts of the same config block, however long: consecutive lines
that are settings, section heads or comments.  The interval join of candidates
is made of running ends and beginnings over each text's candidates by position,
and one aggregate of each block: no pairs are made.

Positions come from the regular-expression engine itself: every match is put
between marks, the text is split at the marks, and lengths are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import text_of
from funnelkit.llm.native import let

SCOPE = 200
# a private-use character put around matches; its own uses in a text are
# read as another one, which no pattern tells from it
_MARK, _OTHER = "", ""

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN, ACCESS_MIN = 8, 16

IDENTIFIER = r"""(?i)\b(?:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user[_-]?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEYLIKE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KEYLIKE_HAS = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"""(?i)\b(?:https?|wss?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+"""
# a line of a config block: a setting of one value, a section head, braces, a comment
CONFIG = r"""(?md)^[ \t]*(?:(?:export[ \t]+|-[ \t]+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[ \t]*[:=][ \t]*(?:"[^"\n]*"|'[^'\n]*'|[^\s"']+|\{|\[)?[ \t]*,?[ \t]*(?:[#;][^\n]*)?|\[[^\]\n]+\]|[{}\[\]]+,?|(?:#|//|;)[^\n]*)[ \t\r]*$"""
KINDS = ("assign", "access", "hex", "identifier", "keylike", "endpoint", "config")
_ROLE = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "keylike": "secret", "endpoint": "endpoint"}


#: parts of a text that are walked together, and repeats of a row written together
GROUP, REPEATS = 128, 4096


def matches(text: Column, kind: str, pattern: str, ok=None) -> Column:
    """array<struct<kind, start, end>> of the leftmost non-overlapping matches
    for which ``ok`` of the matched string holds; code points, end exclusive."""
    k = KINDS.index(kind)
    spans = "array<struct<kind:int,start:int,end:int>>"
    empty = F.array().cast(spans)

    def walked(parts: Column) -> Column:
        """(length, spans) of some parts; the ones at odd places are matches."""
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), empty.alias("out")),
            lambda s, part: F.struct(
                (s["at"] + F.length(part)).alias("at"),
                (~s["hit"]).alias("hit"),
                F.when(s["hit"] & (ok(part) if ok else F.lit(True)),
                       F.concat(s["out"], F.array(F.struct(F.lit(k).alias("kind"), s["at"].alias("start"), (s["at"] + F.length(part)).alias("end")))))
                .otherwise(s["out"]).alias("out")))

    def placed(groups: Column) -> Column:
        """The spans of all groups of parts, each moved by the length of the groups before it."""
        start = F.aggregate(groups, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + g["at"])))
        moved = lambda g, by: F.transform(g["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end")))
        return let(start, lambda at: F.flatten(F.transform(groups, lambda g, i: moved(g, F.get(at, i)))))

    def found(marked: Column) -> Column:
        # a growing array is copied at every step, so parts are walked in
        # groups of an even number of them
        groups = lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GROUP).cast("int")), lambda i: walked(F.slice(parts, i * GROUP + 1, GROUP)))
        return F.when(F.instr(marked, _MARK) == 0, empty).otherwise(let(F.split(marked, _MARK), lambda parts: let(groups(parts), placed)).cast(spans))

    return let(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (array of kind, start, end) for every row.

    A null text is empty and has no spans.  Repeated rows are added up before
    the shuffle and returned as often as they occur; a very long text's matches
    are linked in one task; spans that start together are told
    apart by kind, then end.  Other columns are not read, and an empty table
    gives no rows.
    """
    text = text_of(docs)
    found = F.concat(
        matches(text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_MIN),
        matches(text, "access", ACCESS, lambda m: F.length(m) >= ACCESS_MIN),
        matches(text, "hex", HEX),
        matches(text, "identifier", IDENTIFIER),
        matches(text, "keylike", KEYLIKE, lambda m: F.regexp_like(m, F.lit(KEYLIKE_HAS[0])) & F.regexp_like(m, F.lit(KEYLIKE_HAS[1])) & F.regexp_like(m, F.lit(KEYLIKE_HAS[2]))),
        matches(text, "endpoint", ENDPOINT),
    )
    # lines matter only where there are parts to link
    found = let(found, lambda x: F.when(F.size(x) < 2, x).otherwise(F.concat(x, matches(text, "config", CONFIG))))
    key = ["doc_id", "same", "chars"]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), F.length(text).alias("chars"), found.alias("found"))
    # equal rows meet here, added up before they move; all that follows up to
    # the spans keeps this partitioning
    rows = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.first("found").alias("found"))
    one = rows.select(*key, "rows", F.explode_outer("found").alias("c")).select(*key, "rows", "c.*")
    role = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(KINDS) for x in (k, _ROLE.get(n, "line"))]), F.col("kind"))
    upto = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    line = F.col("role") == "line"
    base = F.col("kind") < 3
    # a block is a run of lines with only a line break between them; a line
    # comes before the parts that begin with it
    before = Window.partitionBy(*key).orderBy("start", ~line).rowsBetween(Window.unboundedPreceding, -1)
    sofar = Window.partitionBy(*key).orderBy("start", ~line).rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("role", role).withColumn("fresh", (line & (F.col("start") > F.coalesce(F.max(F.when(line, F.col("end"))).over(before), F.lit(-2)) + 1)).cast("int"))
    one = one.withColumn("block", F.when(F.max(F.when(line, F.col("end"))).over(sofar) > F.col("start"), F.sum("fresh").over(sofar)))
    after = Window.partitionBy(*key).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(*key, "block")

    def reached(r: str) -> Column:
        mine = F.col("role") == r
        ended = F.col("start") - F.max(F.when(mine, F.col("end"))).over(upto) <= SCOPE
        begins = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end") <= SCOPE
        together = F.col("block").isNotNull() & F.max(F.when(mine, 1)).over(block).isNotNull()
        return F.coalesce(ended, F.lit(False)) | F.coalesce(begins, F.lit(False)) | together

    has = {r: reached(r) for r in ("id", "secret", "endpoint")}
    one = one.select(
        *key, "rows", "kind", "start", "end", "role", base.alias("base"), *[c.alias(f"has_{r}") for r, c in has.items()],
        # a weak candidate inside a base span, or a key-like part of an
        # identifier or endpoint, says nothing new
        F.max(F.when(base | F.col("kind").isin(KINDS.index("identifier"), KINDS.index("endpoint")), F.col("end"))).over(upto).alias("cover"),
        F.max(F.when(base, F.col("end"))).over(upto).alias("base_cover"))
    completed = (
        ((F.col("role") == "id") & F.col("has_secret"))
        | ((F.col("role") == "secret") & (F.col("has_id") | F.col("has_endpoint")))
        | ((F.col("role") == "endpoint") & F.col("has_id") & F.col("has_secret")))
    new = F.when(F.col("role") == "secret", F.coalesce(F.col("cover") < F.col("end"), F.lit(True))).otherwise(
        F.coalesce(F.col("base_cover") < F.col("end"), F.lit(True)))
    told = F.when(F.col("kind").isNotNull() & (F.col("base") | (completed & new)), F.struct("start", "kind", "end"))
    spans = one.groupBy(*key, "rows").agg(F.sort_array(F.collect_list(told)).alias("spans"))
    # a row that occurs very often is dealt over the tasks before it is repeated
    part = spans.select("doc_id", "spans", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / REPEATS))).alias("part"))
    part = part.repartition("doc_id", "part")
    left = F.least(F.col("rows") - F.col("part") * REPEATS, F.lit(REPEATS)).cast("int")
    return part.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), left))).select("doc_id", "spans")


def op8(docs: DataFrame) -> DataFrame:
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
