"""Operator 5: secret scan with a random forest against false positives, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm.common import SPACE, broadcast_if_small, cut_lineage

#: Labelled findings that the forest is grown on at most (about).
MAX_TRAINING = 20_000
#: Letter trigrams that stand for the dictionary.
TRIGRAMS = 120
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
#: Rows of each form that labelled_findings makes.
EACH_FORM = 200
REDACTED = "[SECRET]"

# Names before a secret, and forms that only issued keys have.
_NAMES = "password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential"
_ISSUED = (
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"sk_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [\s\S]*",
)
# A private key in PEM, from its first to its last line.
_PEM = r"()(-----BEGIN [A-Z0-9\x20]{0,30}PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9\x20]{0,30}PRIVATE KEY(?: BLOCK)?-----)"

# Words between a sign of assignment and a credential, and words beside digests and identifiers.
_SCHEMES = "bearer|basic|token|digest|apikey|negotiate"
_DIGESTS = r"(?i)(?:commit|revision|merge|sha-?[0-9]{0,3}|md5|checksum|digest|etag|hash|integrity|crc|uuid|guid|blob|tree|parent|request|trace|session id)"

#: 12 or more of a key's characters.
_CORE = r"[A-Za-z0-9+/_\-]{12,}(?:\.[A-Za-z0-9_\-]{8,}){0,2}={0,2}"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "transitions", "distinct_share", "dictionary", "hex", "issued", "named", "assigned", "quoted", "name_near", "digest_near", "name_after", "word_after", "path_code", "path_test",
)


# A name with its sign of assignment, and the secrets' names that values of any form may follow.
_SIGN = r"[\"']?+[\x20\x09]{0,3}+[:=][\x20\x09]{0,3}+[\"']?+"
_RUN_START = r"(?<![A-Za-z0-9+/_\-])"
_ANY = rf"{_RUN_START}([^\x20\x09-\x0DA-Za-z0-9+/_\-]{{0,4}}+(?:[A-Za-z_.\-]{{2,40}}+{_SIGN})?)((?=[A-Za-z+/_\-]{{0,60}}+[0-9]|[A-Za-z0-9+/_\-]{{20}}){_CORE})"
#: 6 or more of any characters, up to the closing quote or, unquoted, to the end of the word less its punctuation.
_VALUE = r"(?:(?<=[\"'])[^\x20\x09-\x0D\"']{6,}|[^\x20\x09-\x0D\"'`<>,;]{5,}[^\x20\x09-\x0D\"'`<>,;.:)\]}])"
_SCHEME = r"(?:(?i:" + _SCHEMES + r")[\x20\x09]{1,3}+)?+"
_NO_SCHEME = r"(?!(?i:" + _SCHEMES + r")(?:[\x20\x09-\x0D]|$))"
_NAMED = rf"{_RUN_START}((?=[A-Za-z0-9+/_.\-]{{2,80}}+{_SIGN})[A-Za-z0-9+/_.\-]*?(?i:{_NAMES})[A-Za-z0-9_\-]*+{_SIGN}{_SCHEME})({_NO_SCHEME}{_VALUE})"
# What stands before a value that is assigned, or assigned to a secret's name.
_END = rf"[\"']?[\x20\x09]{{0,3}}[:=][\x20\x09]{{0,3}}[\"']?(?:(?:{_SCHEMES})[\x20\x09]{{1,3}})?$"
_IS_ASSIGNED = f"(?i){_END}"
_IS_NAMED = rf"(?i)(?:(?:{_NAMES})[a-z0-9_\-]*{_END}|://[^\x20\x09-\x0D/]{{1,64}}:$)"
# A password in an address: the part between the user's name and the host.
_URL = r"([a-z][a-z0-9+.\-]{1,20}://[^\x20\x09-\x0D:/@\"'<>]{1,64}:)([^\x20\x09-\x0D/@\"'<>]{6,64})@"
#: Characters of the text before a match in which its previous word is looked for.
_BACK = 48


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """id, path, before, finding, after and n for each distinct finding with its neighbourhood.

    A finding is a run of 12 or more of a key's characters that has a digit, or is
    assigned to a name; runs of letters alone aren't keys. What is assigned to a
    secret's name is a finding from 6 characters on, whichever they are, and a
    private key in PEM is one as a whole; so is a password in an address. The words
    before and after are only looked at, so that they may be findings too. A word
    such as Bearer between a name and its value belongs to what stands before.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    any_found, named = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), F.regexp_extract_all(text, F.lit(_NAMED), F.lit(0))
    named = F.when(text.rlike(f"(?i)(?:{_NAMES})"), named)
    blocks = F.when(text.contains("PRIVATE KEY"), F.regexp_extract_all(text, F.lit(_PEM), F.lit(0)))
    addresses = F.when(text.rlike("://[^\\s/]{1,130}@"), F.regexp_extract_all(text, F.lit(_URL), F.lit(0)))
    # What is kept below has a digit, or such a sign before it, or is a key in PEM; texts without either aren't searched.
    docs = docs.where(text.rlike("[0-9:=]") | text.contains("PRIVATE KEY"))
    pieces = {"any": (any_found, _ANY), "named": (named, _NAMED), "block": (blocks, _PEM), "address": (addresses, _URL)}
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        *[m.alias(f"{k}_found") for k, (m, _) in pieces.items()], *[F.when(F.size(m) > 0, F.split(text, p, -1)).alias(f"{k}_between") for k, (m, p) in pieces.items()],
    )
    # A match, the text between it and the match before, that match, and the text behind it.
    kind = "array<struct<match:string,between:string,last:string,behind:string>>"
    rows = [F.coalesce(F.arrays_zip(f"{k}_found", f"{k}_between", F.concat(F.array(F.lit("")), f"{k}_found"), F.slice(f"{k}_between", 2, F.greatest(F.size(f"{k}_found"), F.lit(0)))).cast(kind), F.array().cast(kind)) for k in pieces]
    # Parted by the pattern that found it; a named value that is a key in itself is found by the other one.
    placed = found.select("id", "path", F.posexplode(F.array(*rows)).alias("pattern", "rows")).select("id", "path", "pattern", F.inline("rows")).where("match IS NOT NULL")
    pattern = {k: F.col("pattern") == i for i, k in enumerate(pieces)}
    part = lambda at: F.when(pattern["any"], F.regexp_extract("match", f"^{_ANY}$", at)).when(pattern["block"], F.regexp_extract("match", f"^{_PEM}$", at)).when(pattern["address"], F.regexp_extract("match", f"^{_URL}$", at)).otherwise(F.regexp_extract("match", f"^{_NAMED}$", at))
    ahead = F.concat(F.right("last", F.lit(_BACK)), F.right("between", F.lit(_BACK)))
    previous = F.regexp_extract(F.right(ahead, F.lit(_BACK)), rf"{_RUN_START}[^\x20\x09-\x0D]{{1,40}}+(?:[\x20\x09]{{1,3}}(?i:{_SCHEMES}))?(?:[\x20\x09-\x0D]{{1,3}})?$", 0)
    following = F.regexp_extract(F.left("behind", F.lit(_BACK)), r"^[\"'.,;:)\]}>@]{0,3}[\x20\x09-\x0D]{0,3}([^\x20\x09-\x0D]{1,40})", 1)
    parted = placed.select("id", "path", "pattern", F.concat(previous, part(1)).alias("before"), part(2).alias("finding"), following.alias("after")).where("finding != ''")
    key = F.col("finding").rlike(rf"^(?=[A-Za-z+/_\-]{{0,60}}+[0-9]|[A-Za-z0-9+/_\-]{{20}}){_CORE}$")
    kept = parted.where((pattern["any"] & (F.col("finding").rlike("[0-9]") | F.col("before").rlike(_IS_ASSIGNED))) | (pattern["named"] & ~key) | pattern["block"] | pattern["address"])
    return kept.groupBy("id", "path", "before", "finding", "after").agg(F.count("*").alias("n"))


def dictionary(docs: DataFrame, size: int = TRIGRAMS, text_col: str = "text") -> list[str]:
    """The commonest letter trigrams of the words of all rows."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACE))
    counted = docs.select(word.alias("word")).where("word RLIKE '^[a-z]{3,}[.,]?$'").groupBy("word").agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.char_length("word") - 2))
    grams = counted.select("word", "n", at.alias("at")).select(F.expr("substring(word, at, 3)").alias("gram"), "n").where("gram RLIKE '^[a-z]{3}$'")
    return sorted(r["gram"] for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(size).collect())


def _issued() -> F.Column:
    """Whether a finding has a form that only issued keys have."""
    out = F.lit(False)
    for form in _ISSUED:
        out = out | F.col("finding").rlike(f"^{form}$")
    return out


def described(found: DataFrame, trigrams: list[str]) -> DataFrame:
    """found with a column for each of FEATURES."""
    c, before = F.col("finding"), F.col("before")
    n = F.char_length("finding").cast("double")

    def count(pattern: str) -> F.Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    covered = F.regexp_count(F.lower(c), F.lit(f"(?=(?:{'|'.join(trigrams)}))")).cast("double") if trigrams else F.lit(0.0)
    flag = lambda x: x.cast("double")
    made = {
        "length": F.least(n, F.lit(100.0)),
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "lower_share": count("[a-z]") / n,
        # Changes between digits, capitals and small letters, for each place where one could be.
        "transitions": count("(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]") / (n - 1),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": covered / (n - 2),
        "hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "issued": flag(_issued()),
        "named": flag(before.rlike(_IS_NAMED)),
        "assigned": flag(before.rlike(_IS_ASSIGNED)),
        "quoted": flag(before.rlike("[\"']$")),
        "name_near": flag(before.rlike(f"(?i){_NAMES}")),
        "digest_near": flag(before.rlike(_DIGESTS)),
        "name_after": flag(F.col("after").rlike(f"(?i){_NAMES}")),
        "word_after": flag(F.col("after").rlike("^[A-Za-z]{2,}[.,;]?$")),
        "path_code": flag(F.col("path").rlike(r"(?i)\.(?:py|js|ts|java|go|rb|php|ya?ml|json|env|ini|cfg|conf|sh|tf)$")),
        "path_test": flag(F.col("path").rlike(r"(?i)(?:^|[/_.-])(?:tests?|examples?|fixtures?|docs?|samples?|mocks?)(?:[/_.-]|$)")),
    }
    return found.withColumns(made)


def weak_labels(found: DataFrame) -> DataFrame:
    """found with `label` where a rule is sure: 1.0 for issued forms and for random values of named secrets, 0.0 for words, numbers and unnamed runs without mixed characters; null else."""
    c = F.col("finding")
    random_value = c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(c, ""))) >= F.least(F.lit(8), F.char_length(c) - 1))
    named = F.col("before").rlike(_IS_NAMED) & random_value
    plain = c.rlike("^[A-Za-z_/+-]+={0,2}$") | c.rlike("^[0-9+/_-]+$") | ~F.col("before").rlike("[:=]") & ~c.rlike("^[A-Za-z0-9]{16,}$")
    return found.withColumn("label", F.when(_issued() | named, 1.0).when(plain, 0.0))


# Characters of random parts, syllables of words, and neighbours of secrets and of other runs.
_HEX, _SMALL, _DIGIT = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CAPITAL = _SMALL.upper()
_MIXED = _CAPITAL + _SMALL + _DIGIT
_SYLLABLES = "con ter in for ma tion pro re al er the is at com an de st ing en ver tal der na ment".split()
_NAMED_BEFORE = ("password=", "secret: ", 'api_key = "', "token=", "db_password: '", "ACCESS_KEY=", '"client_secret": "', "auth_token: ", "PGPASSWORD=")
_PLAIN_BEFORE = ("see ", "key ", "id ", "with ", "", "the ", "= ", "use ")
_AFTER = ("", "", "and", "then", "#", "for", "}", "is", "end.")
_PATHS = ("", "web", "src/app.py", "notes", "conf/site.yaml", "tests/a", "docs/b", "forum")
#: Forms of findings: name, label, what stands before, and the finding's parts: fixed text, or characters and how many of them, from least to most.
FORMS = (
    ("named hex", 1.0, _NAMED_BEFORE, ((_HEX, 16, 40),)),
    ("named mixed", 1.0, _NAMED_BEFORE, ((_MIXED, 12, 40),)),
    ("named short", 1.0, _NAMED_BEFORE, ((_MIXED + "!$%&*?", 7, 16), (_DIGIT, 1, 2))),
    ("bearer", 1.0, ("Authorization: Bearer ", "authorization: token ", '"Authorization": "Bearer '), ((_MIXED + "-_", 20, 60),)),
    ("address", 1.0, ("postgres://bob:", "mysql://root:", "amqp://svc:", "https://ci:"), ((_MIXED, 8, 20),)),
    ("cloud key", 1.0, _PLAIN_BEFORE, ("AKIA", (_CAPITAL + _DIGIT, 16, 16))),
    ("forge token", 1.0, _PLAIN_BEFORE, ("ghp_", (_MIXED, 36, 36))),
    ("chat token", 1.0, _PLAIN_BEFORE, ("xoxb-", (_DIGIT, 10, 12), "-", (_MIXED, 12, 24))),
    ("payment key", 1.0, _PLAIN_BEFORE, ("sk_live_", (_MIXED, 24, 24))),
    ("map key", 1.0, _PLAIN_BEFORE, ("AIza", (_MIXED + "-_", 35, 35))),
    ("web token", 1.0, _PLAIN_BEFORE, ("eyJ", (_MIXED, 16, 40), ".eyJ", (_MIXED, 16, 40), ".", (_MIXED + "-_", 20, 43))),
    ("commit", 0.0, ("commit ", "revision ", "Merge ", "parent ", "tree ", "blob "), ((_HEX, 40, 40),)),
    ("short commit", 0.0, ("commit ", "at ", "in "), ((_HEX, 12, 16),)),
    ("sha256", 0.0, ("sha256=", "sha256:", "SHA-256: ", "checksum ", "digest: ", "sha256sum "), ((_HEX, 64, 64),)),
    ("md5", 0.0, ("md5 ", 'etag: "', "MD5=", "hash: "), ((_HEX, 32, 32),)),
    ("integrity", 0.0, ('integrity="', "integrity: "), ("sha512-", (_MIXED + "+/", 86, 86), "==")),
    ("uuid", 0.0, ("id ", "uuid=", "request ", "guid: ", "trace "), ((_HEX, 8, 8), "-", (_HEX, 4, 4), "-4", (_HEX, 3, 3), "-a", (_HEX, 3, 3), "-", (_HEX, 12, 12))),
    ("number", 0.0, ("call ", "order ", "no. ", "isbn=", "account: ", ""), ((_DIGIT, 10, 20),)),
    ("date", 0.0, ("on ", "date=", "since ", ""), ("20", (_DIGIT, 2, 2), "-0", (_DIGIT, 1, 1), "-1", (_DIGIT, 1, 1), "T", (_DIGIT, 2, 2))),
    ("identifier", 0.0, ("def ", "import ", "name=", "see ", "call "), (("", 2, 5), "_", ("", 2, 4), (_DIGIT, 1, 3))),
    ("path", 0.0, ("open ", "in ", "path=", "file: "), (("", 2, 3), "/", ("", 2, 4), (_DIGIT, 1, 2), "/", ("", 2, 3))),
    ("words", 0.0, ("slug=", "the ", "page: ", ""), (("", 3, 6), "-", ("", 3, 6))),
    ("placeholder", 0.0, _NAMED_BEFORE, ("your-", ("", 2, 3), "-here")),
    ("blank", 0.0, _NAMED_BEFORE, (("x", 6, 20),)),
)


def labelled_findings(spark: SparkSession, each: int = EACH_FORM, forms: tuple = FORMS) -> DataFrame:
    """path, before, finding, after, label, form: a table of labelled findings, `each` rows of every form, made by hashes of the row's number.

    Stands in for findings that people have labelled, which secrets() takes as well.
    Paths and words after are drawn alike for all forms.
    """
    row = F.col("id")

    def pick(of: tuple[str, ...] | list[str], *key) -> F.Column:
        return F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(row, *map(F.lit, key)), F.lit(len(of))) + 1).cast("int"))

    def part(form: str, at: int, what) -> F.Column:
        if isinstance(what, str):
            return F.lit(what)
        letters, low, high = what
        n = (F.pmod(F.xxhash64(row, F.lit(form), F.lit(at)), F.lit(high - low + 1)) + low).cast("int")
        of = F.array(*map(F.lit, letters or _SYLLABLES))
        size = len(letters) or len(_SYLLABLES)
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(of, (F.pmod(F.xxhash64(row, F.lit(form), F.lit(at), k), F.lit(size)) + 1).cast("int"))), "")

    out = None
    for form, label, before, parts in forms:
        rows = spark.range(0, each, 1, 1).select(pick(_PATHS, form, 1).alias("path"), pick(before, form, 2).alias("before"), F.concat(*[part(form, k, x) for k, x in enumerate(parts)]).alias("finding"), pick(_AFTER, form, 3).alias("after"), F.lit(label).alias("label"), F.lit(form).alias("form"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass
class SecretModel:
    trigrams: list[str]
    forest: RandomForestClassificationModel | None


def fit(findings: DataFrame, trigrams: list[str], max_training: int = MAX_TRAINING) -> SecretModel:
    """A forest from labelled findings (path, before, finding, after, label); without both labels there is none, and rules alone decide."""
    rows = findings.where("label IS NOT NULL").select("path", "before", "finding", "after", F.col("label").cast("double").alias("label")).distinct()
    # As many of either label, by hash, so that the rare one isn't lost among the common one.
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return SecretModel(trigrams, None)
    share = F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), F.lit(int(min(1.0, max_training / 2 / n) * (1 << 30))))])
    picked = rows.where(F.pmod(F.xxhash64("finding", "before"), F.lit(1 << 30)) < share[F.col("label")])
    # At most about max_training rows, in a fixed order, so that the same rows give the same trees.
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(picked.orderBy("finding", "before", "path", "after").coalesce(1), trigrams))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(table.select("features", "label"))
    return SecretModel(trigrams, forest)


def scored(found: DataFrame, model: SecretModel) -> DataFrame:
    """found with score, the share of trees that call it a secret (the rules' answer without a forest; 0 where they have none)."""
    if model.forest is None:
        return weak_labels(found).withColumn("score", F.coalesce("label", F.lit(0.0))).drop("label")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described(found, model.trigrams))
    return model.forest.transform(table).withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")


def secrets(docs: DataFrame, model: SecretModel | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """A row for each finding of a document that the forest takes for a secret: id, finding, before, n, score.

    Without a model one is grown from labelled_findings and from weak_labels over the
    documents' own findings.
    Null texts have no findings; null paths count as empty; rows with null ids keep
    a null id; repeated rows add to n; other columns are left out; an empty table
    gives an empty one.
    """
    # Written once: labels, forest and scores all read it, and the texts are searched a single time.
    found = cut_lineage(candidates(docs, id_col, text_col, path_col))
    if model is None:
        columns = ["path", "before", "finding", "after", "label"]
        findings = weak_labels(found).select(columns).unionByName(labelled_findings(docs.sparkSession).select(columns))
        model = fit(findings, dictionary(docs, text_col=text_col))
    kept = scored(found, model).where(F.col("score") >= threshold)
    return kept.groupBy(F.col("id").alias(id_col), "finding", "before").agg(F.sum("n").alias("n"), F.max("score").alias("score"))


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = REDACTED) -> DataFrame:
    """docs with each finding of the rows' own ids replaced by mark in the text; columns and other rows stay as they are.

    A column n_chars, if there is one, is counted anew for texts that change.
    """
    # Longer findings first, so that none is replaced inside another.
    byd = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("found_id")).agg(F.array_sort(F.collect_set(F.struct((-F.char_length("finding")).alias("n"), "finding"))).alias("found"))
    size = F.aggregate("found", F.lit(40).cast("long"), lambda total, x: total + 20 + F.octet_length(x["finding"]))
    byd = broadcast_if_small(cut_lineage(byd), size)
    joined = docs.join(byd, docs[id_col] == byd["found_id"], "left")
    text = F.when(F.col("found").isNull(), docs[text_col]).otherwise(F.aggregate("found", docs[text_col], lambda t, x: F.replace(t, x["finding"], F.lit(mark))))
    changed = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.char_length(text_col).cast(docs.schema["n_chars"].dataType)))
    return changed.drop("found_id", "found")
