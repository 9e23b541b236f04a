"""Subject areas of documents by class-association rules over sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytomill.functions.plaintext import fold, plain
from phytomill.runtime import lookup_join, materialize

#: Labelled documents the rules are fitted on at most; so their words and rules are bounded too. Scoring covers all documents.
LABELLED_DOCS = 20_000
#: One in so many labelled documents is kept apart to calibrate on.
HELD_OUT = 4
#: Shards of the FP-growth, and distinct words of a case; longer sentences are several cases.
SHARDS, CASE_TERMS = 48, 64

# a stop before "var." and the like ends no sentence; every alternative begins in the first class, which keeps the scan fast
_STOP = re.compile(
    r"[.!?…\n](?:(?<=[.!?…])(?<!\bvar.)(?<!\bno.)(?<!\bnr.)(?<!\bsubsp.)(?<!\bssp.)(?<!\bcf.)[.!?…]*[\"')\]]*(?=\s|$)|(?<=\n)(?:\s*\n|(?=[#>*-])))"
)
_TERM = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str | None) -> list[list[str]]:
    """The distinct folded words of each sentence that has any; null gives none."""
    if not text:
        return []
    found = map(_TERM.findall, fold(_STOP.sub("\0", plain(text).replace("\0", " "))).split("\0"))
    return [list(dict.fromkeys(w)) for w in found if w]


def _sentence_table(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = [sentences(t) for t in b.column(len(keep)).to_pylist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in per]), pa.int64())
            rows = [w for x in per for w in x]
            no = [k for x in per for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[: len(keep)]), pa.array(no, pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=[*keep, "no", "terms"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "no int", "terms array<string>"])
    return docs.select(*keep, text).mapInArrow(split, schema)


class Tree:
    """An FP-tree as arrays: the distinct prefixes of the cases, each with its cases by class.

    cases: whole-number terms, a row a case, in ascending order and filled up with -1; classes: each case's class.
    """

    def __init__(self, cases: np.ndarray, classes: np.ndarray, count: int):
        order = np.lexsort(cases.T[::-1])
        cases, classes = cases[order], classes[order]
        new = np.ones(cases.shape, dtype=bool)
        new[1:] = np.logical_or.accumulate(cases[1:] != cases[:-1], axis=1)  # a prefix is new where it differs from the row above
        new &= cases >= 0
        self.term = cases[new]
        number = np.where(new, np.cumsum(new.ravel()).reshape(new.shape) - 1, -1)
        node = np.where(cases >= 0, np.maximum.accumulate(number, axis=0), -1)
        above = np.concatenate([np.full((len(cases), 1), -1), node[:, :-1]], axis=1)
        self.parent = above[new]
        there = cases >= 0
        at = node[there] * count + np.broadcast_to(classes[:, None], cases.shape)[there]
        self.cases = np.bincount(at, minlength=len(self.term) * count).reshape(len(self.term), count)

    def conditional(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms above the nodes, positions in `nodes`), one level of the tree after the other."""
        at, up = np.arange(len(nodes)), self.parent[nodes]
        while len(at):
            at, up = at[up >= 0], up[up >= 0]
            if len(at):
                yield self.term[up], at
            up = self.parent[up]


def _summed(keys: np.ndarray, cases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, slot = np.unique(keys, return_inverse=True)
    total = np.zeros((len(which), cases.shape[1]), dtype=np.int64)
    for c in range(cases.shape[1]):
        total[:, c] = np.bincount(slot, cases[:, c], len(which))
    return which, total


def _patterns(tree: Tree, shard: int, shards: int, longest: int, min_count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term, other or -1, cases by class) of the patterns whose last term is of this shard, of min_count cases or more."""
    nodes = np.nonzero(tree.term % shards == shard)[0]
    term, cases = _summed(tree.term[nodes], tree.cases[nodes])
    yield term, np.full(len(term), -1), cases
    if longest == 1 or not len(nodes):
        return
    width = int(tree.term.max()) + 1
    keys, parts = [], []
    for other, at in tree.conditional(nodes):
        key, total = _summed(tree.term[nodes[at]].astype(np.int64) * width + other, tree.cases[nodes[at]])
        keys.append(key)
        parts.append(total)
    if keys:
        key, cases = _summed(np.concatenate(keys), np.concatenate(parts))
        often = cases.sum(axis=1) >= min_count
        yield key[often] // width, key[often] % width, cases[often]


def mine_rules(cases: DataFrame, min_count: int = 3, min_confidence: float = 0.6, longest: int = 2, shards: int = SHARDS) -> DataFrame:
    """Class-association rules (terms, subject, hits, seen, weight) from `cases` (terms ARRAY<STRING>, subject STRING).

    Parallel frequent-pattern growth: terms are ordered by their number of cases; each shard of the terms gets every case up to
    its last term of that shard, builds an FP-tree whose nodes count cases by class, and grows patterns of at most `longest` (1 or 2)
    terms that end in its own terms. Terms seen fewer than min_count times, or whose commonest subject has under half of
    min_confidence, stay out of the trees. A rule needs min_count cases, however many cases there are, and min_confidence of the
    cases with its terms.

    weight: log odds of the smoothed confidence over those of the subject at large. A rule of two terms is redundant, and
    dropped, unless it says more than its terms' own rules for the subject together; its weight is what it adds to theirs.
    """
    if longest not in (1, 2):
        raise ValueError("rules have one or two terms")
    spark = cases.sparkSession
    cases = materialize(cases.filter(F.col("subject").isNotNull()).select("subject", F.array_compact(F.array_distinct("terms")).alias("terms")), "labelled-sentences")
    prior = {r["subject"]: r["n"] for r in cases.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a subject
    total, names = sum(prior.values()), sorted(prior)
    code = {s: k for k, s in enumerate(names)}
    single = cases.select("subject", F.explode("terms").alias("t")).groupBy("t", "subject").agg(F.count(F.lit(1)).alias("hits"))
    useful = single.groupBy("t").agg(F.sum("hits").alias("seen"), F.max("hits").alias("most")).filter((F.col("seen") >= min_count) & (F.col("most") >= F.col("seen") * min_confidence / 2))
    terms = [r["t"] for r in useful.orderBy(F.desc("seen"), "t").select("t").toLocalIterator()]  # of the bounded fit: see LABELLED_DOCS
    sent = spark.sparkContext.broadcast((terms, {t: k for k, t in enumerate(terms)}, code))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rank, code = sent.value
        for b in batches:
            shard, subject, prefix = [], [], []
            for s, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = [rank[t] for t in own if t in rank]
                for part in (sorted(own[a : a + CASE_TERMS]) for a in range(0, len(own), CASE_TERMS)):
                    last = {t % shards: k for k, t in enumerate(part)}
                    for g, k in last.items():
                        shard.append(g)
                        subject.append(code[s])
                        prefix.append(part[: k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(subject, pa.int32()), pa.array(prefix, pa.list_(pa.int32()))], names=["g", "c", "p"])

    def grow(table: pa.Table) -> pa.Table:
        terms, _, _ = sent.value
        prefix = table.column("p").combine_chunks()
        size = np.diff(prefix.offsets.to_numpy())
        own = np.full((len(size), int(size.max())), -1, dtype=np.int32)
        own[np.arange(own.shape[1])[None, :] < size[:, None]] = prefix.flatten().to_numpy()
        tree = Tree(own, table.column("c").to_numpy(), len(names))
        out = [[], [], [], []]
        for term, other, count in _patterns(tree, table.column("g")[0].as_py(), shards, longest, min_count):
            seen = count.sum(axis=1)
            at, c = np.nonzero((count >= min_count) & (count >= seen[:, None] * min_confidence))
            out[0] += [sorted(terms[x] for x in (t, o) if x >= 0) for t, o in zip(term[at].tolist(), other[at].tolist())]
            out[1] += [names[x] for x in c.tolist()]
            out[2] += count[at, c].tolist()
            out[3] += seen[at].tolist()
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()))], names=["terms", "subject", "hits", "seen"])

    schema = "terms array<string>, subject string, hits bigint, seen bigint"
    if not terms:
        return spark.createDataFrame([], schema + ", weight double")
    grown = cases.select("subject", "terms").mapInArrow(scatter, "g int, c int, p array<int>").groupBy("g").applyInArrow(grow, schema)
    share = F.create_map(*[F.lit(x) for s in names for x in (s, prior[s] / total)])
    prior_ = F.element_at(share, F.col("subject"))
    p = (F.col("hits") + prior_) / (F.col("seen") + 1.0)
    odds = lambda x: F.log(F.least(x, F.lit(0.999)) / (1 - F.least(x, F.lit(0.999))))
    rules = materialize(grown.withColumn("weight", odds(p) - odds(prior_)), "rules")
    one = rules.filter(F.size("terms") == 1)
    part = lambda k: one.select(F.col("terms")[0].alias(f"t{k}"), "subject", F.col("weight").alias(f"w{k}"))
    two = rules.filter(F.size("terms") == 2).withColumns({"t1": F.col("terms")[0], "t2": F.col("terms")[1]})
    two = lookup_join(lookup_join(two, part(1), ["t1", "subject"]), part(2), ["t2", "subject"])
    more = F.col("weight") - F.coalesce("w1", F.lit(0.0)) - F.coalesce("w2", F.lit(0.0))
    two = two.withColumn("weight", more).filter("weight > 0")
    return one.unionByName(two.select(one.columns))


class RuleBook:
    """Rules by term; gives a sentence's best subject and by how much its evidence leads."""

    def __init__(self, rows: list[tuple[list[str], str, float]]):
        self.single: dict[str, list[tuple[str, float]]] = {}
        self.pair: dict[str, dict[str, list[tuple[str, float]]]] = {}
        for terms, subject, weight in rows:
            if len(terms) == 1:
                self.single.setdefault(terms[0], []).append((subject, weight))
            else:
                self.pair.setdefault(terms[0], {}).setdefault(terms[1], []).append((subject, weight))

    def judge(self, terms: list[str]) -> tuple[str | None, float]:
        evidence: dict[str, float] = {}
        for t in terms:
            for subject, w in self.single.get(t, ()):
                evidence[subject] = evidence.get(subject, 0.0) + w
        if self.pair:
            own = set(terms)
            for t in own:
                others = self.pair.get(t)
                if others:
                    for other in own & others.keys():
                        for subject, w in others[other]:
                            evidence[subject] = evidence.get(subject, 0.0) + w / 2  # pairs overlap
        if not evidence:
            return None, 0.0
        if len(evidence) == 1:
            return next(iter(evidence.items()))
        first, second = sorted(evidence.items(), key=lambda x: (-x[1], x[0]))[:2]
        return first[0], first[1] - second[1]


def rule_book(rules: DataFrame) -> RuleBook:
    return RuleBook([(r["terms"], r["subject"], r["weight"]) for r in rules.orderBy("terms", "subject").toLocalIterator()])


def _judged(cases: DataFrame, book: RuleBook, keep: list[str]) -> DataFrame:
    sent = cases.sparkSession.sparkContext.broadcast(book)
    kinds = dict(cases.dtypes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sent.value.judge(t) for t in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*keep, "guess", "margin"])

    return cases.mapInArrow(judge, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "guess string", "margin double"]))


@dataclass
class SubjectModel:
    """Rules and the calibrated evidence lead from which a sentence counts as about a subject."""

    rules: DataFrame
    book: RuleBook
    least: float


def _calibrate(judged: DataFrame, share: float, steps: int = 61) -> float:
    """The middle of the leads whose agreement with the labels is within a standard error of the best lead's (steps of a quarter).

    judged: (d, subjects, guess, margin), all sentences of documents that no rule was mined from. Agreement is F1 of the
    documents' subjects. The middle, since labelled documents hold few sentences about no subject, whose chance evidence a least
    lead has to keep out.
    """
    size = Window.partitionBy("d")
    rows = judged.withColumn("n", F.count(F.lit(1)).over(size)).withColumn("least", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("least", F.col("least") / 4)
    given = judged.select("d", F.explode("subjects").alias("s")).distinct().count()
    rows = rows.filter(F.col("guess").isNotNull() & (F.col("margin") > F.col("least")))
    rows = rows.groupBy("least", "d", "guess").agg((F.count(F.lit(1)) >= share * F.first("n") - 1e-9).alias("about"), F.first("subjects").alias("subjects")).filter("about")
    found = {r["least"]: (r["n"], r["k"]) for r in rows.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("subjects", F.col("guess"))).alias("k")).collect()}  # `steps` rows
    scores = {least: 2 * k / (n + given) for least, (n, k) in found.items()}
    if not scores:
        return 0.0
    best = max(scores.values())
    good = [least for least, f in scores.items() if f >= best - (best * (1 - best) / given) ** 0.5]
    return (min(good) + max(good)) / 2


def fit_subjects(
    docs: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", text: str = "text", hint: str | None = None,
    rounds: int = 2, labelled: int = LABELLED_DOCS, share: float = 0.3,
) -> SubjectModel:
    """Fit rules on sentences of labelled documents, in rounds that tell a document's subjects apart.

    The first rules come from labelled documents (each sentence a case of each of the document's subjects) and the words of
    the areas' descriptions. In each further round a sentence takes the subject its evidence names among the document's own, and
    rules are mined anew. The least lead is calibrated on one in HELD_OUT of the documents, read by rules mined from the others,
    since words seen in one document only speak for its subject by chance. `hint` (a column such as the source) serves as a further term in the first rules only. At most
    `labelled` documents are used, those of lowest hash; null texts, ids and subjects, and subjects not among the areas, are left
    out. Documents without a label play no part.
    """
    known = areas.select("subject").dropna().distinct()
    given = labels.select(F.col(doc_id).alias("d"), "subject").dropna().distinct().join(F.broadcast(known), "subject", "left_semi")
    given = materialize(given.groupBy("d").agg(F.sort_array(F.collect_set("subject")).alias("subjects")), "labels")
    n = given.count()
    if n > labelled:
        given = given.filter(F.pmod(F.xxhash64(F.lit("subjects"), F.col("d").cast("string")), F.lit(1 << 30)) < F.lit(int((1 << 30) * labelled / n)))
    base = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("x"), (F.coalesce(F.lower(F.trim(hint)), F.lit("")) if hint else F.lit("")).alias("h")).filter("d is not null and x is not null")
    mine = materialize(_sentence_table(lookup_join(base, given, ["d"], "inner"), "x", ["d", "h", "subjects"]), "sentences")
    described = _sentence_table(areas.filter("description is not null and subject is not null").select("subject", "description"), "description", ["subject"])
    described = described.select("terms", "subject").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("k")
    hinted = F.when(F.col("h") != "", F.array_append("terms", F.concat(F.lit("@"), "h"))).otherwise(F.col("terms"))
    book = rule_book(mine_rules(mine.select(hinted.alias("terms"), F.explode("subjects").alias("subject")).unionByName(described)))
    for _ in range(rounds):
        judged = _judged(mine.withColumn("terms_", F.col("terms")).withColumn("terms", hinted), book, ["d", "subjects", "terms_"])
        own = F.when(F.array_contains("subjects", F.col("guess")), F.col("guess"))
        sure = materialize(judged.select("d", F.col("terms_").alias("terms"), own.alias("subject")), "read")
        rules = materialize(mine_rules(sure.drop("d").unionByName(described)), "subject-rules")
        book = rule_book(rules)
    apart = F.pmod(F.xxhash64(F.lit("apart"), F.col("d").cast("string")), F.lit(HELD_OUT)) == 0
    others = rule_book(mine_rules(sure.filter(~apart).drop("d").unionByName(described)))
    return SubjectModel(rules, book, _calibrate(_judged(mine.filter(apart), others, ["d", "subjects"]), share))


def assign_subjects(docs: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text", share: float = 0.3) -> DataFrame:
    """(doc_id, subject, share): every subject that at least `share` of a document's sentences are about.

    One pass over whole texts without a shuffle; the rules, bounded by the labelled documents they come from, are broadcast. Null and blank texts have no
    subject; repeated documents are each judged; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.book, model.least))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, least = sent.value
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts, counts = sentences(t), {}
                for terms in parts:
                    guess, margin = book.judge(terms)
                    if guess is not None and margin > least:
                        counts[guess] = counts.get(guess, 0) + 1
                out += [(d, s, k / len(parts)) for s, k in counts.items() if k >= share * len(parts) - 1e-9]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=[doc_id, "subject", "share"])

    return docs.select(doc_id, text).mapInArrow(judge, f"{doc_id} {dict(docs.dtypes)[doc_id]}, subject string, share double")
