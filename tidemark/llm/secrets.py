"""Secret scans: raw findings by pattern, false positives removed by a random forest. DataFrame functions only.

A raw finding is a maximal run of eight or more key characters with a digit in it. Its text is split at the findings, so that every finding
stands between its two neighbouring stretches and no position is lost. Features: length, shares of character kinds, transitions between
kinds of characters, distinct characters, dictionary coverage, signs of a path, and the words beside it. The forest is trained on labelled
findings (before, candidate, after, label); by default these are written by ``labelled_findings`` from hashes and templates, ``rows`` of
them. The trained trees are turned into one SQL expression, so documents are scored inside their own row: no join, no shuffle.

Defined results: a null or empty text has no findings; equal rows have equal findings; a finding of any length is one finding; an empty
table gives no rows; extra columns are carried by ``redact`` and ignored by ``findings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, shielded, table

_KEY = r"A-Za-z0-9_+/\-"
CANDIDATE = rf"(?<![{_KEY}])(?=[A-Za-z_+/\-]*[0-9])[{_KEY}]{{8,}}+={{0,2}}"
CONTEXT = 60
BLOCK = 256  # findings whose lengths are summed at a time for positions
TREES, DEPTH, ROWS, SEED = 24, 6, 6000, 17
THRESHOLD = 0.5
MASK = "<secret>"

# Words that names, paths and placeholders are made of, and words beside secrets and beside other numbers.
DICTIONARY = (
    "about", "admin", "and", "api", "app", "archive", "article", "auth", "backup", "bin", "build", "cache", "change", "client", "cloud", "code",
    "com", "commit", "config", "content", "count", "data", "date", "default", "demo", "dev", "dist", "doc", "download", "dummy", "email",
    "etc", "example", "file", "first", "foo", "for", "from", "group", "guide", "here", "home", "how", "html", "http", "image", "index", "info",
    "insert", "item", "key", "last", "lib", "line", "list", "local", "login", "log", "main", "model", "name", "net", "new", "news", "node",
    "number", "opt", "org", "package", "page", "part", "pass", "photo", "post", "prod", "python", "release", "report", "root", "sample",
    "section", "server", "share", "site", "src", "static", "story", "system", "table", "test", "text", "the", "this", "time", "tmp", "token",
    "update", "usr", "user", "value", "var", "version", "video", "web", "week", "word", "work", "world", "www", "year", "your")
BESIDE_SECRETS = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)s?[\"']?\s*(=>|[:=])?\s*[\"']?$"
BESIDE_OTHERS = r"(?i)(card|phone|tel|fax|call|order|invoice|isbn|doi|commit|revision|sha|sha1|sha256|md5|checksum|digest|uuid|id|version|build|date|on|page)[\"')]?\s*(no\.?|#|[:=])?\s*[\"'(]?$"


def features(before: Column, candidate: Column, after: Column) -> list[tuple[str, Column]]:
    """Named features of one finding and its neighbourhood, all doubles."""
    n = F.length(candidate).cast("double")
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    turns = "(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[a-zA-Z])|(?<=[A-Z])(?=[0-9a-z])"
    voices = "(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"
    words = "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    return [
        ("length", n), ("digits", share("[0-9]")), ("upper", share("[A-Z]")), ("lower", share("[a-z]")), ("hex", share("[0-9a-f]")),
        ("marks", share("[^A-Za-z0-9]")), ("turns", share(turns)), ("voices", share(voices)),
        ("distinct", F.size(F.array_distinct(F.split(candidate, ""))) / n),
        ("covered", 1.0 - F.length(F.regexp_replace(F.lower(candidate), words, "")) / n),
        ("slashes", share("/")), ("path", flag(before.rlike(r"[/.@\\~]$") | after.rlike(r"^[/.@\\]\S"))),
        ("dashes", share("[-]")), ("secret_word", flag(before.rlike(BESIDE_SECRETS))), ("other_word", flag(before.rlike(BESIDE_OTHERS))),
        ("assigned", flag(before.rlike("[:=]\\s*[\"']?$"))), ("quoted", flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"))),
    ]


def labelled_findings(spark: SparkSession, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(before, candidate, after, label): findings of known kind, written from hashes; half are secrets."""
    h = lambda salt: F.sha2(F.concat(F.lit(f"{seed}-{salt}-"), F.col("id").cast("string")), 512)
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    span = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(hi - lo + 1)) + lo).cast("int")
    digits = F.translate(h("d"), "abcdef", "012345")
    b64 = F.base64(F.unhex(h("b")))
    alnum = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    noise = F.translate(F.substring(h("n"), 1, 60), "0123456789abcdef", "ethandrosili vua")
    word = lambda salt: pick(salt, *DICTIONARY)
    name = pick("name", "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key")
    sets = pick("set", "=", " = ", ": ", "=\"", " = \"", ": \"", "='")
    hexes = lambda salt: F.substring(h(salt), 1, pick("hx" + salt, 18, 24, 32, 40, 64))
    kinds = [
        # secrets: assigned values, and keys whose form alone tells
        (F.concat(name, sets), hexes("s0"), 1), (F.concat(name, sets), F.substring(b64, 1, span("l1", 20, 60)), 1),
        (F.concat(name, sets), F.concat(F.lit("a1"), F.substring(alnum, 1, span("l2", 12, 50))), 1),
        (F.lit(" "), F.concat(F.lit("AKIA"), F.substring(F.upper(alnum), 1, 16)), 1), (F.lit(" "), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), 1),
        (F.lit(" "), F.concat(F.lit("sk-"), F.substring(alnum, 1, 48)), 1), (F.lit(" "), F.concat(F.lit("AKIA"), F.substring(F.upper(alnum), 1, 16)), 1),
        (F.concat(name, sets), hexes("s7"), 1),
        # what is not secret: card, phone and date numbers, names with numbers, paths, addresses, digests, placeholders
        (pick("c", " ", " card ", " no. "), F.substring(digits, 1, span("l8", 12, 19)), 0),
        (pick("p", " ", " (555) ", " tel "), F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 5, 4), pick("p2", "", "-12", "-3344"), ), 0),
        (pick("w", " ", " the ", "\"", "="), F.concat(word("w1"), pick("j", "", "_", "-"), word("w2"), F.substring(digits, 1, span("l10", 1, 4))), 0),
        (pick("u", "/", " /", "~/", "www.example.com/"), F.concat(word("u1"), F.lit("/"), word("u2"), F.substring(digits, 1, 2), F.lit("/"), word("u3")), 0),
        (pick("m", " commit ", " sha256:", " md5 ", " checksum ", " uuid "), hexes("m"), 0),
        (F.concat(name, sets), pick("x", "example1", "your_token_1", "insert-key-here-1", "changeme123", "test1234", "dummy_value_01", "password1"), 0),
        (pick("y", " on ", " ", " date "), F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 4, 1), F.lit("-1"), F.substring(digits, 7, 1)), 0),
        (F.lit(" "), F.concat(F.substring(F.regexp_replace(noise, " ", ""), 1, span("l15", 8, 24)), F.substring(digits, 1, span("l15b", 1, 2))), 0),
    ]
    k = F.pmod(F.col("id"), F.lit(len(kinds)))
    before, cand, label = F, F, F
    for i, (b, c, y) in enumerate(kinds):
        before, cand, label = before.when(k == i, b), cand.when(k == i, c), label.when(k == i, F.lit(y))
    made = spark.range(rows, numPartitions=1).select(
        F.concat(word("b1"), F.lit(" "), F.substring(noise, 1, 20), before).alias("before"), cand.alias("candidate"),
        F.concat(F.when(F.col("id") > -1, F.substring(before, -1, 1)).otherwise(""), F.lit(" "), F.substring(noise, 20, 20)).alias("_after"), label.alias("label"))
    tail = F.when(F.col("before").rlike("[\"']$"), F.col("_after")).otherwise(F.substring("_after", 2, 40))
    return made.select("before", "candidate", tail.alias("after"), "label").filter(F.col("candidate").rlike(rf"^{CANDIDATE}$"))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """Random forest over the findings' features; ``findings`` is a bounded labelled table."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    named = features(F.col("before"), F.col("candidate"), F.col("after"))
    flat = findings.select(*[c.alias(n) for n, c in named], F.col("label").cast("double").alias("label"))
    vectors = VectorAssembler(inputCols=[n for n, _ in named], outputCol="features").transform(flat).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed).fit(vectors)


def forest_score(model, feature) -> Column:
    """Mean share of label 1 over the trees' leaves as a column; ``feature(i)`` gives the i-th feature's column."""
    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return F.lit(stats[1] / sum(stats))
        split = node.split()
        return F.when(feature(split.featureIndex()) <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    roots = [t.rootNode() for t in model._java_obj.trees()]
    total = walk(roots[0])
    for r in roots[1:]:
        total = total + walk(r)
    return total / len(roots)


def _hold(df: DataFrame) -> DataFrame:
    """The same rows; arrays computed so far are not computed again inside the functions over arrays that follow."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def score(docs: DataFrame, labelled: DataFrame | None = None, context: int = CONTEXT) -> DataFrame:
    """``docs`` with _parts (stretches between findings) and found: array of (start, candidate, score), start in characters from 0."""
    spark = docs.sparkSession
    model = train_forest(labelled if labelled is not None else labelled_findings(spark))
    has = F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))  # a finding has a digit
    none = F.array().cast("array<string>")
    cut = docs.withColumn("_c", F.when(has, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(none)).withColumn(
        "_parts", F.when(F.size("_c") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array(F.coalesce("text", F.lit("")))))
    sizes = F.transform("_c", lambda c, i: F.length(F.get("_parts", i)) + F.length(c))  # a stretch and the finding after it
    cut = _hold(_hold(cut).withColumn("_sizes", sizes))
    whole = F.when(F.size("_c") > 0, F.sequence(F.lit(0), F.expr(f"(size(_c) - 1) div {BLOCK}"))).otherwise(F.array().cast("array<int>"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    cut = _hold(cut.withColumn("_blocks", F.transform(whole, lambda k: total(F.slice("_sizes", k * BLOCK + 1, F.lit(BLOCK))))))
    cut = _hold(cut.withColumn("_before", F.transform("_blocks", lambda _, k: total(F.slice("_blocks", F.lit(1), k)))))

    def described(c: Column, i: Column) -> Column:
        before, after = F.right(F.get("_parts", i), F.lit(context)), F.left(F.get("_parts", i + 1), F.lit(context))
        block = F.floor(i / BLOCK).cast("int")
        start = F.get("_before", block) + total(F.slice("_sizes", block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get("_parts", i))
        return F.struct(start.alias("start"), c.alias("candidate"), *[x.alias(n) for n, x in features(before, c, after)])

    names = [n for n, _ in features(F.lit(""), F.lit("a"), F.lit(""))]
    cut = cut.withColumn("_d", F.transform("_c", described))
    found = F.transform("_d", lambda d: F.struct(d["start"].alias("start"), d["candidate"].alias("candidate"), forest_score(model, lambda i: d[names[i]]).alias("score")))
    return _hold(cut.withColumn("found", found).select(*docs.columns, "_parts", "found"))


def findings(docs: DataFrame, threshold: float = THRESHOLD, **kwargs) -> DataFrame:
    """(doc_id, start, length, sha256, score, secret): every raw finding, its digest instead of its text."""
    f = score(docs.select("doc_id", "text"), **kwargs).select("doc_id", F.explode("found").alias("f"))
    return f.select("doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.candidate").cast("long").alias("length"),
                    F.sha2(F.col("f.candidate").cast("binary"), 256).alias("sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("secret"))


def redact(docs: DataFrame, threshold: float = THRESHOLD, mask: str = MASK, **kwargs) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mask``; texts without a secret stay as they are."""
    return shielded(docs, lambda d: _redact(d, threshold, mask, **kwargs))


def _redact(docs: DataFrame, threshold: float, mask: str, **kwargs) -> DataFrame:
    s = score(docs, **kwargs)
    secret = lambda f: f["score"] >= threshold
    pieces = F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.when(secret(F.get("found", i)), F.lit(mask)).otherwise(F.get("found", i)["candidate"]), F.lit(""))))
    any_ = F.exists("found", secret)
    text = F.when(any_, F.array_join(pieces, "")).otherwise(F.col("text"))
    out = s.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(any_, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    return findings(table(spark, sf_dir, "documents"))
