"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is described by its length, the transitions between kinds of characters, how much of it
dictionary words cover, the path it lies in and the words around it.  The forest is trained by
pyspark.ml and then written out as an SQL expression, so scanning, scoring and redaction are one narrow
step without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions.arrays import lit, running
from hushspan.llm.common import id_text, settled

#: Words that a name of a secret holds.
_NAMES = r"(?:key|secret|token|pass|pwd|auth|credential)"
_SEPARATOR = r"""["'\])]{0,2}\s*+(?:=>|:=|[=:])"""
#: The name of an assigned value with what follows it.  A name is read once, so long words cost no more.
NAME = rf"""(?i:(?<![\w.-])(?=[\w.-]*?{_NAMES})[\w.-]++{_SEPARATOR}\s*+(?:(?:bearer|basic)\s++)?+["']?)"""
#: Scheme and user before the password of a URL.
USER = r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@"']*+:"""
#: Assigned values, passwords in URLs, access key ids, and runs of 16 or more that hold a digit.  A value
#: that is itself a name with a value is left for that; padded base64 is no name.  An assigned value ends at
#: white space or a quote, outside quotes also at ; , & ) ] or }.  A run is read from its front only: what
#: it lacks there, length or a digit, no later part of it has.
CANDIDATE = (
    rf"""(?<![\w.-])(?!(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{16,}}+={{1,2}}(?:\s|$)){NAME}"""
    rf"""(?!(?i:(?=[\w.-]*?{_NAMES})[\w.-]++{_SEPARATOR}\s))(?:(?<=["'])[^\s"']++|(?<!["'])[^\s"';,&)\]}}]++)"""
    rf"""|{USER}[^\s/@"']++(?=@)"""
    r"""|(?<![A-Za-z0-9+_-])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9+/_=-])"""
    r"""|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}""")
#: What comes before the value in an assignment or a URL.
ASSIGNMENT = rf"""^(?:(?!(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{16,}}+={{1,2}}$){NAME}|{USER})"""
#: Names that say what the value is; only these teach the forest what a secret looks like.
SURE_NAME = rf"""^(?i:[\w.-]*?(?:pass(?:word|wd)?|pwd|secret|token|(?:api|access|secret|private|auth)[_-]?key){_SEPARATOR})"""
#: Characters of context that are looked at on either side.
CONTEXT = 80
#: Bounds: findings of each label to fit on, and words of the dictionary.
SAMPLE, DICTIONARY = 10_000, 500
THRESHOLD, TREES, DEPTH, SEED = 0.5, 20, 6, 11
PLACEHOLDER = "<SECRET>"

SECRET_WORDS = r"(?i)\b(key|token|secret|password|passwd|pwd|auth|bearer|credential|credentials|aws|private)\b"
OTHER_WORDS = (r"(?i)\b(card|iban|account|phone|tel|order|invoice|isbn|sha|sha1|sha256|md5|commit|hash|uuid|"
               r"digest|checksum|example|sample|dummy|placeholder|test)\b")
EXAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|doc|vendor)"
KINDS = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "other": "[^A-Za-z0-9]"}


def _value(hit: str) -> str:
    return f"regexp_replace({hit}, {lit(ASSIGNMENT)}, '')"


def features(hit: str, before: str, after: str, path: str, dictionary: str) -> dict[str, str]:
    """SQL expressions of what the forest sees; the arguments are SQL expressions too."""
    value = _value(hit)
    size = f"greatest(length({value}), 1)"
    named = {"length": f"length({value})",
             "runs": f"regexp_count({value}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / {size}",
             "different": f"size(array_distinct(split({value}, ''))) / {size}",
             "hex": f"cast({value} rlike '^[0-9a-f]+$' as int)",
             "vowels": f"regexp_count({value}, '(?i)[bcdfghjklmnpqrstvwxyz][aeiou]') / {size}"}
    for a, left in KINDS.items():
        for b, right in KINDS.items():
            named[f"{a}_{b}"] = f"regexp_count({value}, '{left}(?={right})') / {size}"
    named["dictionary"] = (f"aggregate(array_intersect(regexp_extract_all(lower({value}), '[a-z]{{4,}}', 0), {dictionary}), "
                           f"0, (n, w) -> n + length(w)) / {size}")
    named["path_depth"] = f"regexp_count(coalesce({path}, ''), '/')"
    named["path_example"] = f"cast(coalesce({path}, '') rlike {lit(EXAMPLE_PATH)} as int)"
    named["assigned"] = f"cast({hit} rlike {lit(ASSIGNMENT)} as int)"
    near = f"concat_ws(' ', {before}, regexp_extract({hit}, {lit(ASSIGNMENT)}, 0))"
    named["secret_words"] = f"least(regexp_count({near}, {lit(SECRET_WORDS)}), 3)"
    named["other_words"] = f"least(regexp_count(concat_ws(' ', {before}, {after}), {lit(OTHER_WORDS)}), 3)"
    named["quoted"] = f"cast({before} rlike '[\"\\\\x27=]$' or {hit} rlike '[\"\\\\x27]' as int)"
    return {k: f"cast({v} as double)" for k, v in named.items()}


def _parts(text: str) -> tuple[str, str]:
    """(hits, gaps): the candidates of a text and what lies between them."""
    return f"regexp_extract_all({text}, {lit(CANDIDATE)}, 0)", f"split({text}, {lit(CANDIDATE)}, -1)"


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, path, start, hit, before, after) of every candidate; `start` counts characters from 0."""
    hits, gaps = _parts("text")
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"),
                        F.col(text).alias("text")).withColumn("hits", F.expr(hits)).where("size(hits) > 0")
    cut = found.withColumn("gaps", F.expr(
        f"transform({gaps}, g -> named_struct('last', right(g, {CONTEXT}), 'first', left(g, {CONTEXT}), 'n', length(g)))"))
    starts = running("transform(hits, (h, i) -> named_struct('gap', gaps[i].n, 'n', length(h)))", "0",
                     lambda st, x: (f"{st} + {x}.gap + {x}.n", f"array({st} + {x}.gap)"), "int")
    rows = cut.withColumn("starts", F.expr(starts)).select("doc_id", "path", F.explode(F.expr(
        "transform(hits, (h, i) -> named_struct('start', starts[i], 'hit', h, 'before', gaps[i].last, "
        "'after', gaps[i + 1].first))")).alias("c"))
    return rows.select("doc_id", "path", "c.*")


def label_findings(found: DataFrame) -> DataFrame:
    """Findings with `label` where a validator is sure; the tables hold no labels of findings.

    1: an access key id of its known form, or a value of eight characters or more that is assigned to a
    sure name, mixes letters and digits and is no placeholder.  0: digits alone, an account number of the form of an IBAN, a UUID, or a value that says that it
    is an example, or a plain word where the name does not say password.  All others stay out of training.
    """
    value = _value("hit")
    label = F.expr(f"""case
        when {value} rlike '(?i)example|placeholder|changeme|xxxx|dummy' then 0
        when {value} rlike '^(AKIA|ASIA)[A-Z0-9]{{16}}$' then 1
        when {value} rlike '^[0-9_/+-]+$' then 0
        when {value} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' then 0
        when {value} rlike '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$' then 0
        when hit rlike {lit(SURE_NAME)} and length({value}) >= 8 and {value} rlike '[A-Za-z]' and {value} rlike '[0-9]' then 1
        when {value} rlike '^[A-Za-z][a-z]*[.,;:!?)]*$' and not (hit rlike {lit(SURE_NAME)} and length({value}) >= 8) then 0 end""")
    return found.withColumn("label", label).where("label is not null")


@dataclass
class Forest:
    """Trees as SQL over feature names, and the dictionary; no trees if there was nothing to learn."""

    trees: list[str]
    words: list[str]

    def dictionary(self) -> str:
        return f"array({', '.join(map(lit, self.words))})" if self.words else "cast(array() as array<string>)"

    def score(self, hit: str, before: str, after: str, path: str) -> str:
        """SQL of the share of the forest that holds a candidate to be a secret."""
        if not self.trees:
            return "1.0D"
        named = features(hit, before, after, path, self.dictionary())
        seen = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in named.items()) + ")"
        return f"get(transform(array({seen}), f -> ({' + '.join(self.trees)}) / {len(self.trees)}), 0)"


def _tree(node, names: list[str]) -> str:
    """A node of a pyspark.ml tree as SQL."""
    if node.subtreeDepth() == 0:
        no, yes = list(node.impurityStats().stats())
        return f"{yes / max(no + yes, 1e-12)!r}D"
    split = node.split()
    left, right = _tree(node.leftChild(), names), _tree(node.rightChild(), names)
    return f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {left}, {right})"


def fit(found: DataFrame, labelled: DataFrame) -> Forest:
    """Train on at most SAMPLE labelled findings of each label, those with the smallest hashes, each
    weighed by how many it stands for.

    The dictionary is the most frequent words around all findings.  Without labels of both kinds no
    candidate can be told from another, and all are reported.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    around = F.explode(F.expr("regexp_extract_all(lower(concat_ws(' ', before, after)), '[a-z]{4,}', 0)"))
    words = [r["w"] for r in found.select(around.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
             .orderBy(F.col("n").desc(), "w").limit(DICTIONARY).collect()]
    forest = Forest([], words)
    named = features("hit", "before", "after", "path", forest.dictionary())
    order = F.xxhash64("hit", "before", id_text("doc_id"), "start")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return forest
    parts = [labelled.where(F.col("label") == label).withColumn("h", order).orderBy("h", "hit", "start").limit(SAMPLE)
             .withColumn("weight", F.lit(n / min(n, SAMPLE))) for label, n in sorted(counts.items())]
    sample = settled(parts[0].union(parts[1]).select(
        F.col("label").cast("double").alias("label"), "weight", *[F.expr(v).alias(k) for k, v in named.items()]).coalesce(1))
    ready = VectorAssembler(inputCols=list(named), outputCol="features").transform(sample).select("label", "weight", "features")
    trained = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, weightCol="weight").fit(ready)
    forest.trees = [_tree(t._java_obj.rootNode(), list(named)) for t in trained.trees]
    return forest


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, start, length, value_sha256, score, secret) of every candidate in `docs`.

    `start` and `length` are characters of the value itself, after the name that it is assigned to.
    Null and empty texts have no candidates; repeated rows are scanned each; a null path says
    nothing; other columns are not read.
    """
    found = settled(candidates(docs, doc_id, text, path))
    forest = fit(found, label_findings(found))
    value = F.expr(_value("hit"))
    scored = found.withColumn("score", F.round(F.expr(forest.score("hit", "before", "after", "path")), 9))
    return scored.select(
        "doc_id", (F.col("start") + F.length("hit") - F.length(value)).alias("start"), F.length(value).alias("length"),
        F.sha2(value, 256).alias("value_sha256"), "score", (F.col("score") >= THRESHOLD).alias("secret"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source",
             n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` with PLACEHOLDER for every secret, and `n_chars` (if there is such a column) counted again.

    No row is dropped and rows without a secret stay as they are; all columns are kept.
    """
    found = settled(candidates(docs, doc_id, text, path))
    forest = fit(found, label_findings(found))
    names = [f"c{i}" for i in range(len(docs.columns))]
    by_name = dict(zip(docs.columns, names))
    rows, old = docs.toDF(*names), by_name[text]
    hits, gaps = _parts(old)
    score = forest.score("h", f"right(g[i], {CONTEXT})", f"left(g[i + 1], {CONTEXT})", f"cast({by_name[path]} as string)")
    hidden = f"concat(left(h, length(h) - length({_value('h')})), {lit(PLACEHOLDER)})"
    joined = (f"get(transform(array({gaps}), g -> concat(array_join(flatten(transform({hits}, (h, i) -> "
              f"array(g[i], if(round({score}, 9) >= {THRESHOLD}, {hidden}, h)))), ''), element_at(g, -1))), 0)")
    new = F.expr(f"if(size({hits}) > 0, {joined}, {old})")
    out = rows.withColumn("new", new)
    changed = {text: F.col("new")}
    if n_chars in by_name:
        kind = dict(docs.dtypes)[n_chars]
        same = F.col("new").eqNullSafe(F.col(old))
        changed[n_chars] = F.when(same, F.col(by_name[n_chars])).otherwise(F.length("new").cast(kind))
    return out.select(*[changed.get(c, F.col(n)).alias(c) for c, n in by_name.items()])
