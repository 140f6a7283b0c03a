"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions and the JVM's random forest only.  A candidate is a run of
key characters with a digit in it, the value of an assignment to a word such as
``token``, ``password`` or ``secret_key``, what an Authorization header bears,
or the password of a URL.  The forest sees its length and character
transitions, how much of it dictionary words cover, whether it is part of a
path, and the neighbouring words; it is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import small_side, stored

TREES, DEPTH, SEED = 40, 8, 11
#: Example findings that are generated and learned from when none are given.
EXAMPLES = 6_000
BEFORE, AFTER = 48, 16

_MARK = "\x01"
#: Characters read for a value at first; one that fills them is read again to its end.
WINDOW = 1_024
#: What stands before a value; the value itself with the character before it; all that such a value may hold.
PATTERNS = [
    (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Za-z0-9+/_-]{16})", r"(?s)^.?([A-Za-z0-9+/_-]{16,}={0,2})",
     r"[A-Za-z0-9+/_=-]"),
    # An assignment: the keyword, words joined to it, a sign; a quoted value goes to the quote.
    (r"""(?i)(?:token|secret|passw(?:or)?d|passphrase|passcode|pwd|(?:api|access|private|signing|encryption|master|account|shared)[ _.-]?key"""
     r"""|auth(?:orization)?|credential|bearer)s?(?:[_.-][a-z0-9]{1,20}|[ _.-]?(?:key|token|value|phrase|code)){0,4}"""
     r"""["']?\s{0,3}(?::=|=>|[:=])\s{0,3}["']?(?=[^\s"']{4})""",
     r"""(?s)^.((?<=["\x27])[^\s"\x27]{4,}|(?<!["\x27])[^\s"\x27,;<>(){}\[\]]{3,}[^\s"\x27,;.:<>(){}\[\]])""",
     r"""[^\s"\x27]"""),
    # What an Authorization header bears, and the password of a URL.
    (r"(?i)\b(?:bearer|basic)\s{1,3}(?=[A-Za-z0-9._~+/-]{8})", r"(?s)^.([A-Za-z0-9._~+/-]{7,}[A-Za-z0-9_~+/-]={0,2})",
     r"[A-Za-z0-9._~+/=-]"),
    (r"""://[^\s/:@"'<>]*+:(?=[^\s/@"'<>]{3,}+@)""", r"""(?s)^.([^\s/@"\x27<>]{3,})@""", r"""[^\s/"\x27<>]"""),
]
#: Neighbouring words for and against, and pieces of plain words.
_FOR = r"(?i)(token|secret|passw(or)?d|passphrase|passcode|pwd|key|auth|bearer|credential|private|access|client)"
_AGAINST = r"(?i)(sha\d*|md5|checksum|digest|hash|commit|rev(ision)?|uuid|guid|etag|version|build|isbn|order|invoice|page|card|tracking|integrity|example|placeholder|id)\b"
_PLAIN = r"(?i)(example|placeholder|changeme|sample|dummy|demo|test|your|here|password|secret|token|key|api|version|release|candidate|article|image|index|page|user|file|name|data|home|news|post|blog|item|list|date|time|config|admin|guide|about|product|long|title|with|from|that|this|and|the|for|ing|tion|ment|able|er|in|on|an)"

FEATURES = ["size", "kinds", "digits", "upper", "lower", "vowels", "transitions", "hex", "covered", "same", "uuid",
            "number", "slashes", "in_path", "assigned", "said_for", "said_against", "symbols", "in_url", "bearer"]


def candidates(rows: DataFrame, key: str) -> DataFrame:
    """(row, key, text_key, candidate, start, before, after): every occurrence of a candidate, ``row`` numbers the texts."""
    # A mark goes before each value; a mark of the text's own becomes a blank, so that places stay.
    clean = rows.where(F.col("text").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias(key),
        F.col("text").cast("string").alias("own"), F.translate(F.col("text").cast("string"), _MARK, " ").alias("t"))
    marked = [F.split(F.regexp_replace("t", F.lit(lead), F.lit("$0" + _MARK)), _MARK).alias(f"m{k}")
              for k, (lead, _, _) in enumerate(PATTERNS)]
    marked = clean.select("*", *marked).where(" or ".join(f"size(m{k}) > 1" for k in range(len(PATTERNS))))
    marked = marked.selectExpr("inline(array(struct(*)))")  # computed once, not again in each use
    starts = [f"""aggregate(slice(m{k}, 2, size(m{k})), named_struct('at', length(m{k}[0]), 'starts', cast(array() as array<int>)),
        (s, x) -> named_struct('at', s.at + length(x), 'starts', concat(s.starts, array(s.at + 1))), s -> s.starts)"""
              for k in range(len(PATTERNS))]
    # The value may begin at the text's first character, which has none before it.
    read = "if(i = 1, concat(' ', substring(t, 1{0})), substring(t, i - 1{1}))"
    seen, rest = read.format(f", {WINDOW}", f", {WINDOW} + 1"), read.format("", "")
    spans = [f"""transform({starts[k]}, i -> named_struct('start', i, 'size', length(regexp_extract(
        if(length(t) >= i + {WINDOW} and {seen} rlike r'(?s)^.{held}*+$', {rest}, {seen}), r'{value}', 1))))"""
             for k, (_, value, held) in enumerate(PATTERNS)]
    # Cut out what surrounds a candidate before rows are multiplied, so that no row repeats its text.
    return marked.selectExpr("row", key, "sha2(own, 256) as text_key", f"""inline(transform(filter(array_distinct(concat({', '.join(spans)})), x -> x.size > 0),
        x -> named_struct('candidate', substring(t, x.start, x.size), 'start', cast(x.start as long),
            'before', substring(t, greatest(1, x.start - {BEFORE}), least({BEFORE}, x.start - 1)),
            'after', substring(t, x.start + x.size, {AFTER}))))""")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the forest's inputs, all numbers."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: condition.cast("double")
    near = F.regexp_extract("before", r"(\S*\s*\S*\s*\S*)$", 1)  # the two words before and what touches the candidate
    return found.withColumns({
        "size": n.cast("double"),
        "kinds": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "vowels": share("[AEIOUaeiou]"),
        "transitions": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - F.length(F.regexp_replace(c, _PLAIN, "")) / n,
        "same": flag(c.rlike(r"(.)\1{4,}")),
        "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "number": flag(c.rlike("^[0-9-]+$")),
        "slashes": share("[/_-]"),
        "in_path": flag(F.col("before").rlike(r"(://\S*|/)$") | c.rlike("^/|/.*/") | F.col("after").rlike(r"^(/|\.[a-z]{2,4}\b)")),
        "assigned": flag(F.col("before").rlike(r"""[:=]\s{0,3}["']?$""")),
        "symbols": share("[^A-Za-z0-9]"),
        "in_url": flag(F.col("before").rlike(r"://[^\s/:@]*:$") & F.col("after").startswith("@")),
        "bearer": flag(F.col("before").rlike(r"(?i)\b(bearer|basic)\s+$")),
        "said_for": flag(near.rlike(_FOR)), "said_against": flag(near.rlike(_AGAINST)),
    }).selectExpr("inline(array(struct(*)))")  # computed once, not again in each use


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(id, text, candidate, label): generated labelled findings, the same in every session.

    Label 1: keys, tokens and passwords in assignments, headers and URLs and
    with known prefixes.  Label 0: checksums, commits, uuids, numbers, paths,
    slugs, placeholders, long words with digits, and words, variables and
    addresses that are assigned to such keywords.
    """
    rows = spark.range(n).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("label"),
        F.floor(F.col("id") / 2).alias("i"), *[F.sha2(F.concat_ws("-", F.lit(k), "id"), 512).alias(k) for k in ("a", "b")]).selectExpr(
            "inline(array(struct(*)))")
    rows = rows.withColumns({
        "hex40": F.substring("a", 1, 40), "hex32": F.substring("b", 1, 32), "hex64": F.substring("a", 1, 64),
        "b64": F.substring(F.regexp_replace(F.base64(F.unhex("a")), r"[\r\n]", ""), 1, 40),
        "pad": F.concat_ws(" ", F.translate(F.substring("b", 40, 7), "0123456789", "aeioulnrst"),
                           F.translate(F.substring("b", 50, 5), "0123456789", "aeioulnrst")),
        "letters": F.translate(F.base64(F.unhex("b")), "0123456789+/=\r\n", "qwzxkvjbnmhpr"),
        "mixed": F.translate(F.base64(F.unhex("b")), "+/=\r\n", "xy"),
        "digits": F.translate(F.substring("b", 60, 16), "abcdef", "012345"),
        "word": F.translate(F.substring("a", 70, 9), "0123456789", "aeioulnrst"),
        "quote": F.when(F.col("id") % 4 < 2, '"').otherwise(""),
        "sign": F.when(F.col("id") % 8 < 4, " = ").when(F.col("id") % 8 < 6, "=").otherwise(": "),
    }).selectExpr("inline(array(struct(*)))")
    yes = ["""named_struct('p', concat('token', sign, quote), 'c', hex40)""",
           """named_struct('p', concat('TOKEN', sign, quote), 'c', upper(hex40))""",
           """named_struct('p', concat('api_key', sign, quote), 'c', hex32)""",
           """named_struct('p', concat('secret', sign, quote), 'c', replace(replace(b64, '+', 'x'), '/', 'y'))""",
           """named_struct('p', concat('password', sign, quote), 'c', substring(b64, 1, 14))""",
           """named_struct('p', 'Authorization: Bearer ', 'c', concat('ey', b64))""",
           """named_struct('p', 'key ', 'c', concat('AKIA', upper(translate(substring(a, 1, 16), '01', 'XY'))))""",
           """named_struct('p', 'use ', 'c', concat('ghp_', substring(replace(replace(b64, '+', 'p'), '/', 'q'), 1, 36)))""",
           """named_struct('p', concat('client_secret', sign, quote), 'c', hex64)""",
           """named_struct('p', concat('access_key', sign, quote), 'c', b64)""",
           """named_struct('p', concat('SECRET_KEY', sign, quote), 'c', concat(substring(word, 1, 6), substring(digits, 1, 1), substring(word, 6, 4), '!'))""",
           """named_struct('p', concat('secret_key', sign, quote), 'c', substring(letters, 1, 24))""",
           """named_struct('p', concat('aws_secret_access_key', sign, quote), 'c', substring(letters, 3, 40))""",
           """named_struct('p', concat('api-key', sign, quote), 'c', substring(mixed, 5, 10))""",
           """named_struct('p', concat('passphrase', sign, quote), 'c', concat(substring(word, 1, 7), '.', initcap(substring(word, 4, 5)), substring(digits, 2, 1)))""",
           """named_struct('p', concat('password', sign, quote), 'c', concat(initcap(substring(word, 1, 2)), substring(digits, 3, 1), substring('!?#$%&*@', cast(i % 8 as int) + 1, 1), substring(word, 3, 3)))""",
           """named_struct('p', 'Authorization: Bearer ', 'c', substring(letters, 1, 32))""",
           """named_struct('p', 'Authorization: Bearer ', 'c', lower(substring(letters, 5, 32)))""",
           """named_struct('p', concat('postgres://', substring(word, 2, 5), ':'), 'c', substring(mixed, 7, 9))""",
           """named_struct('p', concat('https://', substring(word, 2, 5), ':'), 'c', concat(substring(word, 1, 6), substring(digits, 4, 2), '!'))""",
           """named_struct('p', concat('db_password', sign, quote), 'c', substring(mixed, 11, 8))""",
           """named_struct('p', concat('private_key', sign, quote), 'c', substring(mixed, 2, 40))""",
           """named_struct('p', concat('pwd', sign, quote), 'c', concat(substring(word, 1, 5), substring(digits, 1, 3)))""",
           """named_struct('p', concat('auth_token', sign, quote), 'c', lower(substring(letters, 1, 20)))"""]
    no = ["""named_struct('p', 'commit ', 'c', hex40)""", """named_struct('p', concat('sha256', sign), 'c', hex64)""",
          """named_struct('p', concat('md5', sign), 'c', hex32)""", """named_struct('p', 'checksum ', 'c', hex40)""",
          """named_struct('p', concat('id', sign, quote), 'c', concat_ws('-', substring(a, 1, 8), substring(a, 9, 4),
             substring(a, 13, 4), substring(a, 17, 4), substring(a, 21, 12)))""",
          """named_struct('p', concat(word, ' '), 'c', digits)""", """named_struct('p', 'card ', 'c', digits)""",
          """named_struct('p', 'https://www.example.com/', 'c', concat('blog/2024/', word, '-', word, '-', substring(digits, 1, 3)))""",
          """named_struct('p', 'see ', 'c', concat('/usr/share/', word, '/', word, '-', substring(digits, 1, 2)))""",
          """named_struct('p', concat('token', sign, quote), 'c', concat('YOUR_TOKEN_HERE_', substring(digits, 1, 3)))""",
          """named_struct('p', concat('api_key', sign, quote), 'c', 'xxxxxxxxxxxxxxxxxxxxxxx1')""",
          """named_struct('p', concat('password', sign, quote), 'c', 'changeme-example1')""",
          """named_struct('p', 'the ', 'c', concat('release-candidate-version-', substring(digits, 1, 2)))""",
          """named_struct('p', concat(word, ' '), 'c', concat(word, word, substring(digits, 1, 1)))""",
          """named_struct('p', 'build ', 'c', concat(substring(digits, 1, 8), '-', substring(digits, 9, 6), '-', substring(a, 1, 7)))""",
          """named_struct('p', 'order ', 'c', concat(substring(digits, 1, 4), '-', substring(digits, 5, 4), '-', substring(digits, 9, 4), '-', substring(digits, 1, 4)))""",
          """named_struct('p', concat('password', sign, quote), 'c', substring(word, 1, cast(4 + i % 6 as int)))""",
          """named_struct('p', concat('secret', sign, quote), 'c', initcap(substring(word, 1, cast(4 + i % 6 as int))))""",
          """named_struct('p', concat('secret_key', sign, quote), 'c', concat('your_', substring(word, 1, 6), '_here'))""",
          """named_struct('p', concat('api-key', sign, quote), 'c', 'your-api-key')""",
          """named_struct('p', concat('token', sign), 'c', element_at(array('none', 'null', 'None', 'true', 'required', 'undefined'), cast(i % 6 as int) + 1))""",
          """named_struct('p', concat('password', sign, quote), 'c', repeat(substring('*x.-', cast(i % 4 as int) + 1, 1), cast(4 + i % 9 as int)))""",
          """named_struct('p', concat('password', sign), 'c', concat(element_at(array('config', 'self', 'settings', 'os'), cast(i % 4 as int) + 1), '.', substring(word, 1, 7)))""",
          """named_struct('p', concat('password', sign), 'c', concat(element_at(array('$', '$DB_', '%', '&'), cast(i % 4 as int) + 1), upper(substring(word, 1, 7))))""",
          """named_struct('p', 'Authorization: ', 'c', element_at(array('Bearer', 'Basic', 'Digest', 'Token'), cast(i % 4 as int) + 1))""",
          """named_struct('p', 'Bearer ', 'c', element_at(array('authentication', 'authorization', 'certificate', 'securities'), cast(i % 4 as int) + 1))""",
          """named_struct('p', 'basic ', 'c', concat(word, substring(word, 1, cast(i % 5 as int))))""",
          """named_struct('p', 'https://user:', 'c', element_at(array('password', 'pass', '$PASSWORD', 'secret'), cast(i % 4 as int) + 1))""",
          """named_struct('p', concat('tokens', sign), 'c', substring(digits, 1, cast(4 + i % 3 as int)))""",
          """named_struct('p', concat('auth', sign), 'c', concat('https://www.', word, '.example/', substring(word, 1, 4)))""",
          """named_struct('p', concat('passwords', sign), 'c', concat(word, '-', substring(word, 1, 5)))""",
          """named_struct('p', concat(word, ' '), 'c', hex40)""", """named_struct('p', concat(word, ' '), 'c', hex32)""",
          """named_struct('p', '', 'c', hex64)"""]
    pick = F.expr(f"if(label = 1, element_at(array({', '.join(yes)}), cast(i % {len(yes)} as int) + 1), "
                  f"element_at(array({', '.join(no)}), cast(i % {len(no)} as int) + 1))")
    return rows.select("*", pick.alias("x")).selectExpr("inline(array(struct(*)))").select(
        "id", F.concat("pad", F.lit(" "), "x.p", "x.c", F.when(F.col("x.p").rlike("://[^/]*:$"), "@db.host").otherwise(F.col("quote")),
                       F.lit(" "), "word").alias("text"),
        F.col("x.c").alias("candidate"), "label")


def train(findings: DataFrame) -> PipelineModel:
    """The forest, from (text, candidate, label) rows; null or other labels are left out."""
    cut = findings.where("label in (0, 1) and text is not null and candidate is not null and candidate != ''").select(
        "candidate", F.col("label").cast("double").alias("label"),
        F.expr(f"substring(text, greatest(1, instr(text, candidate) - {BEFORE}), least({BEFORE}, greatest(instr(text, candidate) - 1, 0)))").alias("before"),
        F.expr(f"substring(text, instr(text, candidate) + length(candidate), {AFTER})").alias("after"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(with_features(cut))


def _found(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """(row, doc_id, text_key, candidate, first, n_found, probability) of the confirmed values."""
    scored = model.transform(with_features(candidates(docs, "doc_id")))
    first = F.when(F.col("prediction") == 1, F.struct("start", "before"))
    found = scored.groupBy("row", "doc_id", "candidate").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n_found"), F.first("text_key").alias("text_key"),
        F.max(vector_to_array("probability")[1]).alias("probability"))
    return found.where("first is not null")


def find_secrets(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """doc_id, secret, start, n_found, before and probability of each secret the forest confirms.

    Every occurrence is judged in its own context; a value is a secret if one
    of them is confirmed.  One row per row of ``docs`` and distinct value, with
    the place of the first confirmed occurrence (from 1), the number of its
    occurrences, confirmed or not, and the highest probability.  A value is read
    to its end, however long it is.  Null and empty texts have none; null ids and
    repeated rows are scanned like any other; an empty table gives an empty
    result; other columns are ignored.
    """
    return _found(docs, model).select(
        "doc_id", F.col("candidate").alias("secret"), "first.start", "n_found", "first.before",
        F.round("probability", 6).alias("probability"))


def text_key(col: str = "text"):
    """Tells texts apart, whatever the ids of their rows."""
    return F.sha2(F.col(col).cast("string"), 256)


def redact(docs: DataFrame, model: PipelineModel, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets that the forest confirms in a row's text replaced by ``mark``.

    A secret goes wherever it stands as a whole, not inside a longer word.
    ``n_chars``, if there is one, is counted anew for changed rows.  Rows are
    told apart by their texts, so rows without doc_id and rows that repeat one
    are treated like any other; rows without a finding and null texts are
    unchanged; an empty table gives an empty result; all columns are kept.
    """
    found = _found(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), model)
    by_text = found.groupBy(F.col("text_key").alias("__key")).agg(F.collect_set("candidate").alias("__secrets"))
    # Longest first, so that a secret inside another one does not cut it.
    ordered = stored(by_text.select("__key", F.expr(
        "array_sort(__secrets, (x, y) -> case when length(x) != length(y) "
        "then length(y) - length(x) when x < y then -1 when x > y then 1 else 0 end)").alias("__secrets")), "secrets-by-text")
    size = F.expr("aggregate(__secrets, 100L, (n, x) -> n + octet_length(x))")
    joined = docs.withColumn("__key", text_key()).join(small_side(ordered, size), "__key", "left")
    whole = lambda s: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                               F.lit(r"\E(?![\p{L}\p{N}])"))
    text = F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(
        F.aggregate("__secrets", F.col("text").cast("string"), lambda t, s: F.regexp_replace(t, whole(s), F.lit(mark))))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return joined.withColumn("text", text).withColumns({k: v for k, v in out.items() if k != "text"}).select(*docs.columns)
