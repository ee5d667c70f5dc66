"""Secret scan: candidates by shape, false positives removed by a random forest.
Built from DataFrame functions and Spark ML alone.

Candidates are runs of 8 or more token characters that hold a digit, change from
small to capital letters inside, or are 16 capitals or 20 letters long; whatever
stands, 6 or more characters long, behind a secret-like name and ``=`` or ``:``;
and the head line of a private key.  (A run of small letters alone is a candidate
only behind such a name: it looks like any word.)
Its features are length, character-class transitions, kinds of characters, the
part of its letters that dictionary words cover, traces of a path, and the words
beside it.  The dictionary holds the words of the corpus that occur ``min_count``
times or more (over all documents) and ``WORDS``.  The forest is trained on
labelled findings: (value, before, after, label).  Where a user has none,
``made_findings`` makes a bounded table of them by rule (``n`` is its size); a
forest trained on it knows the shapes of that rule, not those of a user's code.

Edge cases: null or empty texts have no candidate; a null doc_id is kept;
repeated rows give repeated results; labelled rows with nulls are ignored;
findings of one label only give that label to all; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .pii import free, let, located

_TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_.-]*+[0-9]|[a-z]++[A-Z]|[A-Z]++[a-z]++[A-Z]|[A-Z]{16}|[A-Za-z]{20})[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]={0,2}"
_NAMES = r"(?:secret|token|passw|pwd|passphrase|api[_-]?key|auth|bearer|credential|(?:private|access|client)[_-]?key)"
_ASSIGNED = rf"(?i){_NAMES}[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,3}}[:=]>?\s{{0,3}}[\"']?([^\s\"'<>,;]{{6,}})"
_KEY_HEAD = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
_HINTS = r"(?i)(?:secret|token|passw|pwd|api|auth|bearer|credential|private|access|key)"
_BENIGN = r"(?i)(?:commit|sha|md5|digest|checksum|hash|uuid|guid|version|build|order|card|isbn|phone|serial|etag|revision)"
WORDS = "about access account after alpha archive article background before build button center chapter color component config content default document download example feature figure final first friday house image index item large library light linux local margin minor model monday number order package page party people place point program project public quick release report sample section server shared small source summer system table template test the thing thumb today update usr version water widget width window winter world year".split()
FEATURES = ("length", "moves", "variety", "digits", "uppers", "symbols", "hexed", "covered", "slashes", "dotted", "hinted", "benign", "assigned", "quoted", "prefixed", "worded")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, found): per row of ``docs`` the candidates' start, end,
    value and the text around them."""
    text = F.coalesce("text", F.lit(""))

    def values(found: Column) -> Column:
        """Assignments cut down to the value."""

        def cut(s: Column) -> Column:
            value = F.regexp_extract(s["value"], _ASSIGNED, 1)
            start = s["end"] - F.length(value)
            left = F.right(F.concat(s["left"], F.substring(s["value"], F.lit(1), start - s["start"])), F.lit(60))
            return F.struct(start.alias("start"), s["end"].alias("end"), value.alias("value"), left.alias("left"), s["right"].alias("right"))

        return F.filter(F.transform(found, cut), lambda s: F.length(s["value"]) >= 6)

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    named = F.when(text.rlike(rf"(?i){_NAMES}"), values(located(text, _ASSIGNED))).otherwise(none)
    heads = F.when(text.contains("-----BEGIN "), located(text, _KEY_HEAD)).otherwise(none)
    tokens = F.when(text.rlike("[0-9]|[a-z][A-Z]|[A-Za-z]{16}"), located(text, _TOKEN)).otherwise(none)
    spans = let(named, lambda n: F.array_sort(F.concat(n, free(F.concat(F.array_sort(F.concat(heads, tokens))), n))))

    def around(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.right(s["left"], F.lit(40)).alias("before"), F.left(s["right"], F.lit(20)).alias("after"))

    return docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", F.xxhash64("text").alias("mark"), F.transform(spans, around).alias("found"))


def made_findings(spark: SparkSession, n: int = 8800) -> DataFrame:
    """``n`` labelled findings (value, before, after, label), made by rule."""
    id_ = F.col("id")
    hexed, more = F.sha2(id_.cast("string").cast("binary"), 256), F.sha2(F.concat(F.lit("b"), id_.cast("string")).cast("binary"), 256)
    coded = F.translate(F.base64(F.unhex(hexed)), "+/=", "-_A")
    size = 16 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(25))

    def pick(words: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (1 + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words)))).cast("int"))

    w = [pick(WORDS, 10 + i) for i in range(4)]
    number = F.conv(F.substring(more, 1, 12), 16, 10)
    uuid = F.concat_ws("-", *(F.substring(hexed, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rows = [  # before, value, after, label
        (F.concat(pick(["token", "api_key", "secret", "auth_token", "access_key"], 1), F.lit(' = "')), F.substring(hexed, F.lit(1), size), F.lit('"'), 1),
        (F.concat(pick(["password", "pwd", "passwd", "db_password"], 2), F.lit("=")), F.substring(more, F.lit(1), size), F.lit(" "), 1),
        (F.concat(w[0], F.lit(" ")), F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(F.base64(F.unhex(more)), "+/=", "ABC"), 1, 16))), F.lit(" "), 1),
        (F.concat(pick(["Authorization: Bearer ", "api-key: ", "secret: ", "private_key: "], 4)), F.substring(coded, F.lit(1), size + 4), F.lit("\n"), 1),
        (F.concat(w[1], F.lit(" ")), F.concat(pick(["ghp_", "sk_live_", "xoxb-", "glpat-"], 5), F.substring(coded, F.lit(1), size)), F.lit(" "), 1),
        (pick(["commit ", "revision ", "sha1 ", "sha256:", "md5 ", "digest: ", "etag: "], 6), F.substring(hexed, F.lit(1), size), F.lit(" "), 0),
        (F.concat(w[0], pick([" ", " uuid ", " guid: "], 7)), uuid, F.lit(" "), 0),
        (F.concat(w[1], F.lit(" ")), F.rpad(number, 16, "7"), F.lit(" "), 0),
        (F.concat(w[2], F.lit(" /")), F.concat_ws("/", w[0], w[1], F.concat(w[2], F.substring(number, 1, 3))), F.concat(F.lit("."), pick(["html", "png", "so", "txt"], 8)), 0),
        (F.concat(w[3], F.lit(" ")), F.concat_ws("-", w[0], w[1], w[2], F.substring(number, 1, 4)), F.lit(" "), 0),
        (F.lit("version "), F.concat_ws("_", w[0], w[3], F.substring(number, 1, 8)), F.lit(" "), 0),
        (F.concat(w[2], F.lit(" ")), F.concat(F.initcap(w[0]), F.initcap(w[1]), F.initcap(w[3]), F.substring(number, 1, 1)), F.lit("("), 0),
        (F.concat(pick(["password: ", "pwd=", "secret = ", 'passphrase: "', "client_key="], 20)), F.concat(F.initcap(w[0]), pick(["!", "@", "#", "$", "%"], 21), F.substring(number, 1, 4), w[1]), F.lit("\n"), 1),
        (F.concat(pick(["password = '", 'token: "', "api_key=", "secret="], 22)), F.substring(hexed, F.lit(1), 6 + size % 6), F.lit("'"), 1),
        (F.concat(pick(["password=", "passphrase: ", "db_passwd="], 23)), F.concat(w[0], w[1], w[2]), F.lit(" "), 1),
        (F.concat(w[0], F.lit("\n")), F.concat(F.lit("-----BEGIN "), pick(["RSA ", "EC ", "", "OPENSSH "], 24), F.lit("PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.concat(pick(["password: ", "token: ", "secret: ", "auth: ", "api key: "], 25)), pick(["required", "optional", "missing", "invalid", "expired", "changed", "nothing", "string"], 26), F.lit(" "), 0),
        (F.concat(w[0], F.lit(" ")), F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-1"), F.substring(number, 3, 1), F.lit("-2"), F.substring(number, 4, 1)), F.lit(" "), 0),
        (F.concat(w[1], F.lit(" ")), F.concat_ws(".", w[0], w[1], F.concat(w[2], F.substring(number, 1, 2)), F.lit("org")), F.lit("/"), 0),
        (F.concat(w[2], F.lit(" +")), F.concat_ws("-", F.substring(number, 1, 2), F.substring(number, 3, 3), F.substring(number, 6, 4)), F.lit(" "), 0),
        (F.concat(w[3], F.lit(" ")), F.concat(w[0], F.initcap(w[1]), F.initcap(w[2])), F.lit("("), 0),
        (F.concat(w[3], F.lit(" ")), F.concat(w[0], F.lit("-"), F.substring(number, 1, 5)), F.lit(", "), 0),
    ]
    cases = F.array(*(F.struct(b.alias("before"), v.alias("value"), a.alias("after"), F.lit(y).alias("label")) for b, v, a, y in rows))
    return spark.range(n).select(F.element_at(cases, (id_ % len(rows) + 1).cast("int")).alias("c")).select("c.*")


def _pieces(value: str) -> Column:
    return F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: F.length(w) >= 4)


def dictionary(docs: DataFrame, min_count: int = 5) -> DataFrame:
    """(word) of 4 or more letters seen ``min_count`` times or more, and WORDS."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 4").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("word")
    fixed = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, WORDS))).alias("word"))
    return words.union(fixed).distinct()


def featured(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (value, before, after, ...) with the ``FEATURES``."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    shape = F.translate(v, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    pieces = rows.select(v, F.explode(_pieces("value")).alias("word")).distinct()
    covered = pieces.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("known"))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(v, pattern, ""))) / n

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    values = {
        "length": F.least(n, F.lit(200)).cast("double"), "moves": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n, "variety": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"), "hexed": flag(v.rlike("^[0-9a-f]+$")), "covered": F.least(F.lit(1.0), F.coalesce("known", F.lit(0)) / F.greatest(letters, F.lit(1))),
        "slashes": share("/"), "dotted": flag(F.col("after").rlike(r"^\.[a-z]{1,4}\b") | F.col("before").rlike(r"[/.]$")), "hinted": flag(F.col("before").rlike(_HINTS + r"[\w-]*\W{0,4}$")), "benign": flag(F.col("before").rlike(_BENIGN + r"[\w-]*\W{0,4}$")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s?[\"']?$")), "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")), "prefixed": flag(v.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk_|xox[abp]-|glpat-|AIza|-----BEGIN)")),
        "worded": flag(v.rlike("^[a-z]+$")),
    }
    joined = rows.join(covered, "value", "left")
    return joined.select(*(joined[c] for c in rows.columns), *(values[k].alias(k) for k in FEATURES))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit(findings: DataFrame, words: DataFrame, trees: int = 30, depth: int = 8, seed: int = 3):
    """A forest from labelled findings; a number if there is one label only."""
    known = findings.where("value is not null and label in (0, 1)").select("value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label"))
    rows = materialize(featured(known, words), "secret-train")
    labels = [r.label for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(rows))


def score(rows: DataFrame, words: DataFrame, model) -> DataFrame:
    """``rows`` with ``chance``, the forest's probability of a secret."""
    if isinstance(model, float):
        return rows.withColumn("chance", F.lit(model))
    kept = rows.columns
    out = model.transform(_vectors(featured(rows, words)))
    return out.select(*kept, vector_to_array("probability")[1].alias("chance"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, min_count: int = 5) -> DataFrame:
    """(doc_id, mark, found): a row for each row of ``docs``; found lists start,
    end, value and chance of every candidate, in order."""
    spark = docs.sparkSession
    rows = materialize(candidates(docs), "secret-candidates")
    words = materialize(dictionary(docs, min_count), "secret-words")
    model = fit(made_findings(spark) if findings is None else findings, words)
    each = rows.select("doc_id", "mark", F.explode("found").alias("f")).select("doc_id", "mark", "f.*").distinct()
    scored = score(each, words, model)
    grouped = scored.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", F.round("chance", 6).alias("chance"), (F.col("chance") >= threshold).alias("secret")))).alias("scored"))
    grouped = grouped.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "scored")
    out = rows.join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,chance:double,secret:boolean>>")
    return out.select("doc_id", "mark", F.coalesce("scored", none).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the registered query."""
    secret = F.filter("found", lambda s: s["secret"])
    spans = F.array_join(F.transform(secret, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.size(secret).cast("long").alias("n_secrets"), spans.alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["chance"])), F.lit(0.0)).alias("top_chance"))
