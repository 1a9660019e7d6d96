"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on labelled random strings, the other on labelled ordinary identifiers; a long token is a secret where
the mean log-likelihood ratio of its character pairs is over a threshold midway between the classes' means. Samples are made
by rule (`SAMPLES` each, a documented bound) and counted by grouped aggregation; the model is one array of 4,489 numbers, one for each pair of the 66 token characters and "other".
All of it is DataFrame functions.

Places are code points, end exclusive. A pattern's matches are the leftmost that do not overlap; as many texts lie between
them, their lengths give the places. Tokens that overlap a pattern's span add none. Null or empty text has no spans;
repeated rows are scanned row by row. Texts of any length are scanned whole, in their row. Spans that begin at the same place stand in the order of
their kinds. A table without rows gives none; columns of docs may have any names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: The patterns, their kinds in order, and the least length of what counts.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so the least length can stand in the pattern
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"  # whole runs, with digits or without: the models decide
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
CLASSES = len(ALPHABET) + 1
SAMPLES = 3000
PARTS = ["get", "set", "user", "name", "value", "max", "min", "count", "index", "file", "path", "data", "list", "table", "row", "column", "time", "date", "start", "end", "config", "server", "client", "request", "response", "handler", "manager", "service", "update", "delete", "create", "read", "write", "buffer", "string", "number", "total", "item", "order", "price", "status", "error", "message", "version", "2024", "v1", "01", "100"]
#: More ordinary words, so that the second model knows the letter pairs of ordinary identifiers.
PARTS += """
about above account action active address after again agent alert align amount analysis angle answer apply area argument array assign async auth author available average backup balance base batch
before begin below binary block board body border bottom branch bridge browser build button cache call cancel card case category cell center chain change channel character check child choice class
clean clear click clock close cloud code collect color command comment commit common compare complete component compute condition connect constant contact contain content context control convert copy
core correct country cover current customer cycle damage deep default define degree delay depend deploy depth describe design detail device dialog different digit direct disk display distance document
domain double download draft draw drop dynamic early edge edit effect element empty enable encode engine enter entity environment equal escape estimate event example exact except exchange execute
exist expand expect expire export express extend extra factor failure feature fetch field filter final finish first fixed flag float flow focus folder follow font force foreign format forward found
frame free frequency front function future gate general generate global graph green group growth guide half happy hash head health height hidden high history host house human image import inch include
income increase info inner input insert inside install instance integer interface internal interval invalid issue job join journal judge jump keep kernel keyboard kind know label language large last
later layer layout lead learn left legal length level library light limit line link load local lock logic long loop machine mail main make map mark market mask master match math matrix measure media
member memory menu merge metadata method metric middle minute missing mode model module money monitor month mouse move multiple native nature network never node normal note notify object observe
offset online open operation option output outer owner package page paper parameter parent parse part patch pattern payment people percent period phase phone picture pixel place plain plan player
plugin point policy pool popular position power prefix prepare previous primary print private process product profile program project property protocol provider public publish pull purchase quality
query question queue quick quiet random range rate ratio raw reach ready real reason record recover reduce reference region register relation release remote remove render repeat replace report require
reset resize resource result retry return review right role root rotate round route rule sample save scale schedule schema scope score screen script scroll search second section secure select send
sensor sequence series session share sheet shift short show side signal simple single size sleep slice small snapshot social socket sort sound source space special speed split stack stage standard
state static station step stop storage store stream street strict structure student style submit success summary support switch symbol sync system target task team template temporary term test text
theme thread threshold through ticket title today together top topic total touch trace track trade traffic train transaction transfer transform translate travel tree trigger true trust type under
union unique unit unknown unlock until upload upper usage valid vector vehicle verify view virtual visible visit voice volume wait walk warning watch water weather weight western while white whole
width window winter wire without word work world wrap yellow young zero zone
""".split()


def _code(c: Column) -> Column:
    """The class of a character: its place in ALPHABET, 0 for any other."""
    return F.instr(F.lit(ALPHABET), c)


def _pairs(s: Column) -> Column:
    """The codes of all neighbouring characters."""
    return F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda i: _code(F.substring(s, i, F.lit(1))) * CLASSES + _code(F.substring(s, i + 1, F.lit(1))))


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(secret 0/1, s): labelled strings, the same each time."""
    i = F.col("id").cast("string")
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    digest = F.sha2(i, 256)
    random = F.when(F.col("id") % 2 == 0, F.substring(digest, 1, 40)).otherwise(F.translate(F.substring(F.base64(F.unhex(digest)), 1, 40), "=", ""))
    snake = F.concat_ws("_", part(1), part(2), part(3), part(4), part(5))
    joined = F.when(F.col("id") % 4 == 1, F.translate(snake, "_", "-")).otherwise(F.concat(F.lit("/"), F.translate(snake, "_", "/")))
    camel = F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4)), F.initcap(part(5)))
    # Numbers that people write: ordinal, telephone and book numbers, dates, in groups of digits.
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    number = F.concat(F.when(F.col("id") % 3 == 0, F.concat(F.upper(part(6)), F.lit("-"))).when(F.col("id") % 3 == 1, F.lit("+")).otherwise(""), F.concat_ws("-", F.substring(digits(7, 4), 1, 2), digits(8, 3), digits(9, 2), digits(10, 6), digits(11, 2), F.substring(digits(12, 5), 1, 4)))
    number = F.when(F.col("id") % 4 == 2, F.translate(number, "-", "/")).when(F.col("id") % 4 == 3, F.translate(number, "-", "_")).otherwise(number)
    stamp = F.concat(F.lit("20"), digits(13, 2), F.lit("-"), digits(14, 2), F.lit("-"), digits(15, 2), F.lit("T"), digits(16, 2), F.lit("-"), digits(17, 2), F.lit("-"), digits(18, 2), F.lit("+0"), digits(19, 3))
    plain = F.when(F.col("id") % 4 == 0, snake).when(F.col("id") % 4 == 2, camel).otherwise(joined)
    plain = F.when(F.col("id") % 7 == 5, number).when(F.col("id") % 14 == 6, stamp).otherwise(plain)
    ids = spark.range(n)
    return ids.select(F.lit(1).alias("secret"), random.alias("s")).union(ids.select(F.lit(0).alias("secret"), plain.alias("s")))


def train(spark: SparkSession) -> tuple[list[float], float]:
    """Log-likelihood ratio of each pair of character classes (CLASSES squared, add-half smoothed), and the threshold of its mean."""
    labelled = samples(spark)
    counts = labelled.select("secret", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("pair").agg(F.sum("secret").alias("r"), F.sum(1 - F.col("secret")).alias("o"))
    first = counts.withColumn("a", F.floor(F.col("pair") / CLASSES)).groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    of_a = {x["a"]: (x["ra"], x["oa"]) for x in first.collect()}
    seen = {x["pair"]: (x["r"], x["o"]) for x in counts.collect()}
    from math import log

    table = []
    for pair in range(CLASSES * CLASSES):
        (r, o), (ra, oa) = seen.get(pair, (0, 0)), of_a.get(pair // CLASSES, (0, 0))
        table.append(log((r + 0.5) / (ra + CLASSES / 2)) - log((o + 0.5) / (oa + CLASSES / 2)))
    mean = {x["secret"]: x["m"] for x in labelled.groupBy("secret").agg(F.avg(score(F.col("s"), table)).alias("m")).collect()}
    return table, (mean[0] + mean[1]) / 2


@lru_cache(maxsize=4)
def _trained(application: str) -> tuple[list[float], float]:
    """train(), once an application: its samples are fixed."""
    return train(SparkSession.active())


def score(s: Column, table: list[float]) -> Column:
    ratios = F.array(*map(F.lit, table))
    return F.aggregate(_pairs(s), F.lit(0.0), lambda t, p: t + F.get(ratios, p.cast("int"))) / F.greatest(F.char_length(s) - 1, F.lit(1))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start,kind,end,match>> of a pattern's matches, in order."""

    def placed(m: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        return F.aggregate(
            F.zip_with(F.slice(between, 1, F.size(m)), m, lambda n, x: F.struct(n.alias("n"), x.alias("x"))),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["n"] + F.char_length(x["x"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["n"]).alias("start"), (acc["at"] + x["n"] + F.char_length(x["x"])).alias("end"), x["x"].alias("match")))).alias("out")),
        )["out"]

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: array<struct<start, ord, kind, end>>, by start, then kind in order."""
    table, cut = _trained(docs.sparkSession.sparkContext.applicationId)
    text = F.col("text")
    told = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = told.select("doc_id", _found(text, ASSIGN, "assign").alias("a"), _found(text, ACCESS, "access").alias("k"), _found(text, HEX, "hex").alias("h"), _found(text, TOKEN, "markov").alias("t"))
    as_spans = lambda x, n, kind: F.transform(x, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("ord"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    assigned = F.filter("a", lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN_VALUE, 1)) >= 6)
    based = found.withColumn("base", F.array_sort(F.concat(as_spans(assigned, 0, "assign"), as_spans(F.col("k"), 1, "access"), as_spans(F.col("h"), 2, "hex"))))
    added = F.filter("t", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (score(m["match"], table) > cut))
    return based.select("doc_id", "base", F.when(F.size("t") > 0, as_spans(added, 3, "markov")).otherwise(F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """The report's columns."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
