"""Secret scans: patterns propose, a random forest removes false positives. DataFrame functions only.

Candidates are all runs of key characters and dots in a word, split at any other sign, and the parts
of a run between slashes and dots (a token that holds dots itself, as ``DOTTED``, is not split at them),
of at least ``MIN_LENGTH`` characters each (around a part with a provider's prefix, only the part); only plain words (letters in lower case, the first may be a
capital) that nothing is assigned to are left out. Run and part are candidates of their own, so a key
with slashes may be found as a whole and by its long parts. Features of a candidate: length, shares of digits, upper and lower case, changes of
character class and of kind (letter to digit and back) per character, distinct characters, hex
share, coverage by dictionary fragments, a provider prefix, whether the path looks like test or
example material, and neighbouring words that name a secret or a sample.

The forest is fitted with Spark's DataFrame ML on a labelled table of findings (value, before,
after, path, label; at most ``MAX_LABELLED`` rows, by hash). Where no table is given, ``labelled``
makes one from rules: random keys of several alphabets in key-like and plain surroundings against
joined words, repeated and counting strings, paths, version strings and placeholders.

Defined results: null and empty texts give no findings; a null path counts as an empty one. Repeated
rows give repeated findings; an empty table gives an empty result; texts of any length are read whole; values of
the same score are all returned. Extra columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 16
MAX_LABELLED = 20_000
TREES = 20

WORD_GAP = r"[\x20\x09-\x0D]+"
KEY_CHARS = r"A-Za-z0-9+/_\-."
#: What stands before a run (1) and the run with its padding (2).
RUN = rf"([^{KEY_CHARS}]*)([{KEY_CHARS}]+(?:=++(?![{KEY_CHARS}]))?)"
#: Tokens that hold dots.
DOTTED = r"^(eyJ|SG\.)"

# Words beside a candidate, fragments of ordinary words, prefixes of providers' keys, path parts.
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth|bearer)"
SAMPLE_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|checksum|sha1|sha256|md5|commit|revision|uuid|digest)"
FRAGMENTS = (
    "tion", "ing", "the", "and", "ent", "able", "ment", "ness", "ous", "ight", "ough", "ther", "ver", "est", "ion", "ich", "sch", "ein", "ung",
    "heit", "keit", "lich", "che", "que", "eau", "oir", "eux", "aux", "cion", "mente", "ado", "ista", "los", "con", "pre", "pro", "com", "per",
    "example", "test", "sample", "your", "key", "here", "user", "name", "http", "www", "file", "path", "data", "config", "readme", "version",
)
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|SG\.|npm_|hf_|eyJ)"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|specs?|examples?|samples?|fixtures?|docs?|mocks?)([/_.-]|$)"

FEATURES = [
    "length", "digits", "uppers", "lowers", "changes", "kinds", "distinct", "hexes", "dictionary", "prefix", "test_path", "secret_near", "sample_near", "assigned",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """id, path, position (of the word, from 0), word (the run before the value in it, signs and value), value, before and after (neighbouring words) per candidate."""
    place = F.col(path).cast("string") if path else F.lit("")
    words = docs.select(F.col(id_col).alias("id"), F.coalesce(place, F.lit("")).alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(F.get("w", i)) >= MIN_LENGTH)

    def near(i, a: int, b: int) -> Column:
        first = F.greatest(i + a, F.lit(0))
        return F.array_join(F.slice("w", first + 1, F.greatest(i + b - first, F.lit(0))), " ")

    rows = F.transform(at, lambda i: F.struct(i.cast("long").alias("position"), F.get("w", i).alias("word"), near(i, -3, 0).alias("before"), near(i, 1, 3).alias("after")))
    found = words.select("id", "path", F.explode(rows).alias("x")).select("id", "path", "x.*")
    found = found.withColumn("signs", F.regexp_extract_all("word", F.lit(RUN), F.lit(1))).withColumn("runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(2)))
    # Filtered before they become rows, which would carry a long word's arrays each.
    runs = F.transform("runs", lambda x, i: F.when(F.length(x) >= MIN_LENGTH, F.struct(F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("signs", i)).alias("lead"), x.alias("run"))))
    found = found.withColumn("x", F.explode(F.array_compact(runs))).select("id", "path", "position", "before", "after", "x.*")
    run = F.regexp_replace("run", r"^\.+|\.+$", "")
    parts = F.split(run, "/")
    pieces = F.flatten(F.transform(parts, lambda x: F.when(x.rlike(DOTTED), F.array(x)).otherwise(F.split(x, r"\."))))
    values = F.filter(F.array_distinct(F.concat(F.array(run), F.transform(parts, lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")), pieces)), lambda x: F.length(x) >= MIN_LENGTH)
    # What merely surrounds a part with a provider's prefix is no candidate.
    found = found.withColumn("values", values).withColumn("known", F.filter("values", lambda x: x.rlike(PREFIXES)))
    own = F.filter("values", lambda x: x.rlike(PREFIXES) | ~F.exists("known", lambda y: F.contains(x, y)))
    found = found.withColumn("value", F.explode(own)).drop("values", "known").withColumn("word", F.concat("lead", "value")).drop("run", "lead")
    # Plain words are prose; the forest sees all others.
    return found.where(~F.col("value").rlike("^[A-Z]?[a-z]+$") | F.col("word").rlike("[=:]"))


def features(found: DataFrame) -> DataFrame:
    """``found`` (value, word, before, after, path) with FEATURES as doubles."""
    v = F.col("value")
    n = F.length(v).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    near = F.concat_ws(" ", "before", "word")
    covered = n - F.length(F.regexp_replace(F.lower(v), "|".join(FRAGMENTS), ""))
    values = {
        "length": F.least(n, F.lit(80.0)),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "changes": share("(?=(?:[a-z][A-Z0-9]|[A-Z][a-z0-9]|[0-9][A-Za-z]))."),
        "kinds": share("(?=(?:[A-Za-z][0-9]|[0-9][A-Za-z]))."),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40.0)),
        "hexes": share("[0-9a-f]"),
        "dictionary": covered / n,
        "prefix": v.rlike(PREFIXES).cast("double"),
        "test_path": F.col("path").rlike(TEST_PATH).cast("double"),
        "secret_near": near.rlike(SECRET_WORDS).cast("double"),
        "sample_near": F.concat_ws(" ", near, "after").rlike(SAMPLE_WORDS).cast("double"),
        "assigned": (F.col("word").rlike("[=:]") | F.col("before").rlike("[=:]$")).cast("double"),
    }
    return found.withColumns({k: values[k].cast("double") for k in FEATURES})


def labelled(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """A table of labelled findings made by rule: value, word, before, after, path, label."""
    i = F.col("id")

    def pick(salt: str, *options) -> Column:
        return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))

    seed = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(seed)), "[\r\n=]", "")
    size = (F.pmod(F.xxhash64(F.lit("n"), i), F.lit(25)) + 16).cast("int")
    url64 = F.translate(b64, "+/", "-_")
    upper = F.translate(F.upper(F.substring(b64, 1, 60)), "+/0189", "QXYZWV")
    key = pick(
        "key",
        F.substr(seed, F.lit(1), size),
        F.substr(b64, F.lit(1), size),
        F.concat(F.lit("AKIA"), F.substr(upper, F.lit(1), F.lit(16))),
        F.concat(F.lit("ghp_"), F.substr(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), F.lit(36))),
        F.substr(F.regexp_replace(b64, "[+/]", "_"), F.lit(1), size),
        F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), F.substr(url64, F.lit(1), size), F.lit("."), F.substr(url64, F.lit(43), F.lit(43))),
        F.concat(F.lit("SG."), F.substr(url64, F.lit(1), F.lit(22)), F.lit("."), F.substr(url64, F.lit(23), F.lit(43))),
    )
    parts = [pick(f"w{k}", "user", "config", "The", "berkeit", "ation", "mente", "lich", "data", "Service", "handler", "queux", "over", "ending", "able") for k in range(6)]
    digit = F.pmod(F.xxhash64(F.lit("d"), i), F.lit(9999)).cast("string")
    no = pick(
        "no",
        F.concat(*parts),
        F.concat(*parts[:4], digit),
        F.concat_ws("_", *parts[:4], digit),
        F.concat_ws("/", *parts[:4], F.concat(parts[4], digit)),
        F.concat_ws("-", *parts[:4], digit),
        F.repeat(digit, 6),
        F.lit("1234567890123456789012"),
        F.concat(F.lit("YOUR_API_KEY_HERE_"), digit),
        F.concat(F.repeat(F.lit("x"), 20), digit),
        F.concat(F.lit("0123456789abcdef"), F.lit("0123456789abcdef")),
        F.concat(F.lit("v"), digit, F.lit("-release-candidate-"), digit),
        F.upper(F.concat(*parts)),
        F.lower(F.concat_ws("-", *parts[:4])),
        F.concat_ws(".", F.lit("www"), *parts[:3], F.lit("com")),
        F.concat(F.lit("//"), F.concat_ws(".", parts[0], parts[1], F.lit("org/")), F.concat_ws("/", *parts[2:5], digit)),
        F.concat_ws(".", digit, digit, digit, digit, digit),
        F.rpad(F.concat(F.lit("4"), F.conv(F.substr(seed, F.lit(1), F.lit(12)), 16, 10)), 16, "7"),
    )
    label = F.pmod(F.xxhash64(F.lit("label"), i), F.lit(2))
    hash_like = (label == 0) & (F.pmod(F.xxhash64(F.lit("h"), i), F.lit(5)) == 0)
    value = F.when(label == 1, key).when(hash_like, F.substr(seed, F.lit(1), F.lit(40))).otherwise(no)
    plain = F.pmod(F.xxhash64(F.lit("plain"), i), F.lit(3)) == 0
    before = F.when(hash_like, pick("hb", "the commit was", "sha256 checksum", "md5 digest of", "revision at")).when(
        label == 1, F.when(plain & value.rlike(PREFIXES), pick("pb", "of the end", "and then with", "den und der")).otherwise(pick("sb", "the token =", "my password", "api_key :", "secret =", "auth bearer", "password =", "and then token ="))
    ).otherwise(pick("nb", "of the end", "and then with", "den und der", "see the token", "in the file =", "the password for"))
    assigned = (label == 1) & before.rlike("(password|secret)")
    word = F.when(assigned, F.concat(F.lit("password="), value)).when(value.startswith("//"), F.concat(F.lit("https:"), value)).otherwise(value)
    path = pick("path", "src0", "src1", "app/settings.py", "src/main.go", F.when(label == 0, "tests/fixtures/a.py").otherwise("deploy/env.sh"), "web/index")
    return spark.range(rows).select(value.alias("value"), word.alias("word"), before.alias("before"), F.lit("and the").alias("after"), path.alias("path"), label.cast("double").alias("label"))


def train(table: DataFrame, max_rows: int = MAX_LABELLED, seed: int = 11) -> PipelineModel:
    """Fit the forest on a labelled table (at most about ``max_rows`` of it, by hash of the value)."""
    n = max(1, table.count())
    share = F.xxhash64(F.lit("secret"), "value", "before").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(features(table.where(share < max_rows / n)))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=8, seed=seed, subsamplingRate=0.8)
    model: RandomForestClassificationModel = forest.fit(rows.select("features", "label"))
    return PipelineModel(stages=[assembler, model])


def held_out(table: DataFrame, share: float = 0.25) -> DataFrame:
    """One row: n, precision and recall on about ``share`` of a labelled table (by hash of the value) that a forest fitted on the rest hasn't seen."""
    part = F.xxhash64(F.lit("held out"), "value").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31) < share
    got = train(table.where(~part)).transform(features(table.where(part)))
    said, true = vector_to_array("probability")[1] >= 0.5, F.col("label") == 1
    both = F.count_if(said & true)
    return got.agg(F.count(F.lit(1)).alias("n"), (both / F.count_if(said)).alias("precision"), (both / F.count_if(true)).alias("recall"))


def scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, position, value_sha256, length, score, secret. Values themselves are not returned."""
    scored = model.transform(features(candidates(docs, id_col, text, path)))
    p = vector_to_array("probability")[1]
    return scored.select(
        F.col("id").alias(id_col), "position", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"), p.alias("score"), (p >= threshold).alias("secret")
    )
