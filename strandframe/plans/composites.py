"""Analyses made of several operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates, fuzzy, joins, nested
from ..sources.formats import named_by

# Product keywords of neighbour genes, and ordered product groups.
NEIGHBOUR_KEYWORDS = [
    "transposon", "transposase", "regulator", "transcriptional regulator", "TetR", "transporter", "insertion sequence", "reductase",
    "ferredoxin", "subunit beta", "ferredoxin subunit", "binding protein", "subunit alpha", "small subunit", "electron transfer component",
]
PRODUCT_RULES = [
    ("transcriptional regulator", "G_Regulator"), ("transporter", "G_Transporter"), ("transposase", "G_Transposase"),
    ("regulator", "G_Regulator"), ("insertion sequence", "G_Transposase"), ("reductase", "G_Reductase"),
    ("ferredoxin", "G_Ferredoxin"), ("oxygenase small subunit", "G_OxygenaseSubunit"), ("oxygenase subunit beta", "G_OxygenaseSubunit"),
]
GROUP_LABELS = {"1_": "Group I", "2_": "Group II", "3_": "Group III", "4_": "Group IV", "5_": "Group V"}


def fuzzy_group(df: DataFrame, scope: Sequence[str], text: str, position: str, rules=PRODUCT_RULES, threshold: float = 0.9, scorer: str = "edit") -> DataFrame:
    """Groups of similar product names of each scope, after the product rules; see `operators.fuzzy`."""
    return fuzzy.fuzzy_group(df, scope, text, position, rules, threshold, scorer)


def neighbour_features(targets: DataFrame, features: DataFrame, reach: int = 10_000, keywords: Sequence[str] = NEIGHBOUR_KEYWORDS, max_overlap: float = 80.0) -> DataFrame:
    """Genes near each target. targets: target_id, record_id, target_start, target_end. features: as scan_genbank."""
    genes = features.where(F.col("type").isin("gene", "CDS")).withColumn("product", F.coalesce(F.try_element_at(F.try_element_at("qualifiers", F.lit("product")), F.lit(1)), F.lit("Unknown")))
    genes = genes.where(S.any_keyword(F.col("product"), keywords)).select("record_id", "record_length", "ordinal", "product", "start", "end")
    found = joins.window_proximity(targets, genes, ["record_id"], ("target_start", "target_end"), ("start", "end"), reach, max_overlap=max_overlap)
    return found.select("target_id", "record_id", "product", "start", "end", F.col("gap").alias("relative"), F.col("side").alias("type"), "ordinal")


def replicon_type(features: DataFrame, by: str = "record_id") -> DataFrame:
    """by (a record or a file) and seq_type, Genome, Plasmid or Unclassified: the definition line decides before the molecule type,
    plasmid before genome there. The last source feature decides, and in a file that of its last record."""
    source = features.where("type = 'source'").select(by, "record_no", "ordinal", F.lower("definition").alias("d"), F.lower(F.try_element_at(F.try_element_at("qualifiers", F.lit("mol_type")), F.lit(1))).alias("m"))
    kind = F.coalesce(
        F.when(F.col("d").contains("plasmid"), "Plasmid"), F.when(F.col("d").contains("genome"), "Genome"),
        F.when(F.col("m").contains("genomic"), "Genome"), F.when(F.col("m").contains("plasmid"), "Plasmid"), F.lit("Unclassified"),
    )
    return aggregates.best_hit(source.select(by, (-F.col("record_no")).alias("n"), (-F.col("ordinal")).alias("o"), kind.alias("seq_type")), [by], [F.col("n"), F.col("o")]).drop("n", "o")


def enrichment(flanks: DataFrame, cluster: str = "cluster", product: str = "product", relative: str = "relative", position: str = "position", threshold: float = 0.9, rules=PRODUCT_RULES, scorer: str = "edit") -> DataFrame:
    """Group scores of each cluster: products are grouped, then scored by proximity and number; the best first. With a threshold
    over 1 only the rules group, and any other product stands alone."""
    groups = fuzzy_group(flanks, [cluster], product, position, rules, threshold, scorer)
    scored = aggregates.proximity_score(flanks.join(groups, [cluster, product]), "group", relative, [cluster], product)
    return scored.orderBy(cluster, F.desc("score"), "group")


def heat_matrix(scores: DataFrame, value: str, group: str, score: str, file: str, groups: Sequence[str]) -> DataFrame:
    """value x group matrix of scores: log10, then 0 to 1 inside each file; only groups named G_."""
    named = scores.where(F.col(group).startswith("G_"))
    scaled = aggregates.minmax_scale(named, [file], S.log10_eps(F.col(score)), "scaled")
    return nested.pivot_matrix(scaled, value, group, F.first("scaled"), groups)


def heat_matrix_of_files(spark: SparkSession, path: str, groups: Sequence[str], named: str, of: str = "file") -> DataFrame:
    """The heat matrix of the score tables of a folder whose names begin with `named`_value_: files tell group and value. With
    of="folder" the names are those that a writer's partitionBy gave to folders."""
    reader = spark.read.option("recursiveFileLookup", of != "file")
    scores = reader.csv(path, header=True, schema="Group string, Score double").select("Group", "Score", named_by(of).alias("file"))
    of_file = scores.withColumn("dims", S.filename_to_dims(F.col("file"))).where(F.col("dims.group") == named).withColumn("value", F.col("dims.value"))
    return heat_matrix(of_file, "value", "Group", "Score", "file", groups)


def classify_proteins(proteins: DataFrame, hits: DataFrame, metadata: DataFrame, max_e_value: float = 1e-10) -> DataFrame:
    """Each protein with its best hit under the cut-off (cluster `N/A` without one) and its metadata, whose values win."""
    best = aggregates.best_hit(hits.where(F.col("e_value") < max_e_value), ["target_name"], [F.col("e_value"), -F.col("score"), F.col("query_name")])
    joined = proteins.join(best.withColumnRenamed("target_name", "_id"), "_id", "left").withColumn("PredictedCluster", F.coalesce("query_name", F.lit("N/A")))
    return joins.merge_structs(joined, metadata, ["_id"])


def locate_hits(segments: DataFrame) -> DataFrame:
    """start, end and nucleotide id of each query: the first segment of its last hit."""
    first = segments.where("segment_no = 0")
    return aggregates.best_hit(first.select("query", (-F.col("query_no")).alias("q"), (-F.col("hit_no")).alias("h"), "start", "end", F.col("hit").alias("nucleotide_id")), ["query"], [F.col("q"), F.col("h")]).drop("q", "h")


def pair_regulators(genes: DataFrame, max_distance: int = 1000, main: str = "MAIN_GENE", other: str = "REGULATOR") -> DataFrame:
    """Each main gene with the nearest regulator of its file and contig by midpoint; the first in the file among equals. In order.

    The nearest is found once for each midpoint of main genes, over sorted ranges, so genes crowded on a contig are not paired."""
    middle = genes.where("reject IS NULL").withColumn("mid", S.midpoint(F.col("start"), F.col("end")))
    left = middle.where(F.col("kind") == main).select("file", "contig", F.col("ordinal").alias("m_ordinal"), F.col("mid").alias("m_mid"), F.col("seq").alias("m_seq"))
    right = middle.where(F.col("kind") == other).select("file", "contig", F.col("ordinal").alias("r_ordinal"), F.col("mid").alias("r_mid"), F.col("seq").alias("r_seq"))
    at = ["file", "contig", "m_mid"]
    near = joins.nearest_sorted(left.select(*at).distinct(), right, ["file", "contig"], "m_mid", "r_mid", "r_ordinal").where(F.col("distance") <= max_distance)
    return left.join(near, at).select("file", "contig", "m_ordinal", "m_mid", "m_seq", "distance", "r_ordinal", "r_mid", "r_seq").orderBy("file", "m_ordinal")


def nearest_flanks(targets: DataFrame, flanks: DataFrame) -> DataFrame:
    """Each target (contig, target_id, target_start) with the flank (start, end, product, ordinal) of its contig whose start is nearest,
    the first by ordinal among equals, and the header of that flank's record."""
    near = joins.nearest_sorted(targets, flanks, ["contig"], "target_start", "start", "ordinal")
    return near.withColumn("header", S.header_compose(F.lit("REGULATOR"), F.col("product"), F.col("start"), F.col("end"), F.col("contig")))


def divergence(first: DataFrame, second: DataFrame, aligned: str = "aligned") -> DataFrame:
    """One row: the mean p-distance of two alignments and which of them diverges more (first, second or equal)."""
    one, two = (aggregates.mean_p_distance(a, aligned).select(F.col("mean_distance").alias(n), F.lit(0).alias("__k")) for a, n in ((first, "first_mean"), (second, "second_mean")))
    return one.join(two, "__k").select("first_mean", "second_mean", aggregates.compare_means(F.col("first_mean"), F.col("second_mean")).alias("verdict"))


def alignment_distances(alignment: DataFrame) -> DataFrame:
    """id_a, id_b and the share of columns that differ, for all pairs of one alignment."""
    pairs = joins.self_pairs(alignment.select("id", "aligned"), "id")
    return pairs.select("id_a", "id_b", S.p_distance(F.col("aligned_a"), F.col("aligned_b")).alias("distance"))


def drawn_place(replicate: Column, place: Column, n: Column, seed: int) -> Column:
    """A number from 0 to n - 1 for each replicate and place, in arithmetic that any engine has: squares modulo a prime."""
    prime = F.lit((1 << 31) - 1)
    x = F.pmod(F.lit(seed * 15_485_863) + replicate.cast("long") * 7_919 + place.cast("long") * 104_729, prime)
    for _ in range(3):
        x = F.pmod(x * x + 12_345, prime)
    return F.pmod(x, n.cast("long"))


def bootstrap_distances(alignment: DataFrame, replicates: int = 100, seed: int = 1) -> DataFrame:
    """replicate, id_a, id_b, distance over columns drawn with replacement; the draw follows from seed, replicate and place.

    Each replicate is drawn once, as the number of times that each place comes up; a pair's distance is the sum over the places
    where its two texts differ."""
    runs = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    places = alignment.agg(F.max(F.length("aligned")).alias("n")).where("n > 0").select("n", runs).select("n", "replicate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    drawn = places.groupBy("replicate", drawn_place(F.col("replicate"), F.col("i"), F.col("n"), seed).cast("int").alias("place")).agg(F.count("*").alias("times"))
    letters = alignment.select("id", F.split("aligned", "").alias("letters"))
    pairs = joins.self_pairs(letters, "id").select("id_a", "id_b", F.size("letters_a").alias("n"), F.arrays_zip("letters_a", "letters_b").alias("both"))
    differing = pairs.select("id_a", "id_b", F.posexplode("both").alias("place", "l")).where("l.letters_a <> l.letters_b")
    sums = differing.join(drawn, "place").groupBy("replicate", "id_a", "id_b").agg(F.sum("times").alias("s"))
    every = pairs.select("id_a", "id_b", "n", runs)
    return every.join(sums, ["replicate", "id_a", "id_b"], "left").select("replicate", "id_a", "id_b", (F.coalesce("s", F.lit(0)) / F.col("n")).alias("distance"))


def joined_tree(distance: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Neighbour joining of n leaves, 0 to n - 1: (a, b, length of a's branch, length of b's) of each new node n, n + 1, ..., until
    two nodes are left, which the last entry joins by one branch. The least sum decides; of equal ones the first pair, in an
    order where leaves come before nodes."""
    n = len(distance)
    d, live, steps, new = distance.astype(np.float64).copy(), list(range(n)), [], n
    while len(live) > 2:
        m = len(live)
        total = d.sum(axis=1)
        q = (m - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(m)] = np.inf
        i, j = divmod(int(q.argmin()), m)
        of_i = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        steps.append((live[i], live[j], float(of_i), float(d[i, j] - of_i)))
        rest = [k for k in range(m) if k not in (i, j)]
        to_new = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], to_new[:, None]], [to_new[None, :], np.zeros((1, 1))]])
        live = [live[k] for k in rest] + [new]
        new += 1
    if len(live) == 2:
        steps.append((live[0], live[1], 0.0, float(d[0, 1])))
    return steps


def _tree_of(names: list[str], distances: np.ndarray) -> tuple[str, list[str]]:
    """(Newick text, bipartitions as the sorted leaves of the side without the first name, joined by commas)."""
    steps = joined_tree(distances)
    text, leaves = dict(enumerate(names)), {i: 1 << i for i in range(len(names))}
    whole, splits = (1 << len(names)) - 1, set()
    for new, (a, b, of_a, of_b) in enumerate(steps, len(names)):
        if new == len(names) + len(steps) - 1:
            text[new] = f"({text[a]},{text[b]}:{of_b:.6f});"
            break
        text[new], leaves[new] = f"({text[a]}:{of_a:.6f},{text[b]}:{of_b:.6f})", leaves[a] | leaves[b]
        side = whole & ~leaves[new] if leaves[new] & 1 else leaves[new]
        if 1 < side.bit_count() < len(names) - 1:
            splits.add(side)
    newick = text[len(names) + len(steps) - 1] if steps else f"{names[0]};"
    return newick, sorted(",".join(n for i, n in enumerate(names) if s >> i & 1) for s in splits)


def neighbour_joining(distances: DataFrame) -> DataFrame:
    """replicate, tree (Newick) and splits (sorted leaves of each bipartition, joined by commas). Joining is sequential, so each
    replicate is one group; its size is the square of the number of taxa. Replicates are dealt over the tasks."""

    def build(table: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*table["id_a"], *table["id_b"]})
        number = {n: i for i, n in enumerate(names)}
        a, b = table["id_a"].map(number).to_numpy(), table["id_b"].map(number).to_numpy()
        d = np.zeros((len(names), len(names)))
        d[a, b] = d[b, a] = table["distance"].to_numpy()
        tree, splits = _tree_of(names, d)
        return pd.DataFrame({"replicate": [table["replicate"].iloc[0]], "tree": [tree], "splits": [splits]})

    return distances.groupBy("replicate").applyInPandas(build, "replicate int, tree string, splits array<string>")


def split_support(trees: DataFrame) -> DataFrame:
    """split and the per cent of replicates whose tree has that bipartition."""
    total = trees.count()
    return trees.select(F.explode("splits").alias("split")).groupBy("split").agg((F.count("*") * 100.0 / max(total, 1)).alias("support"))


def consensus_splits(trees: DataFrame, least: float = 50.0) -> DataFrame:
    """split, support, size and parent of the bipartitions that more than `least` per cent of the trees have. Of such splits each two
    are nested or disjoint, so the parent of one is the least that holds it; it is null under the root. least must be 50 or more.

    A split meets others through a leaf that it shares with them: those that hold its first leaf."""
    if least < 50:
        raise ValueError("splits of half the trees or fewer may contradict each other")
    kept = split_support(trees).where(F.col("support") > least).select("split", "support", F.split("split", ",").alias("leaves"))
    sized = kept.withColumn("size", F.size("leaves"))
    inner = sized.select("split", F.col("size").alias("own"), F.get("leaves", F.lit(0)).alias("leaf"))
    outer = sized.select(F.col("split").alias("around"), F.col("size").alias("around_size"), F.explode("leaves").alias("leaf"))
    parents = inner.join(outer, "leaf").where("around_size > own").groupBy("split").agg(F.min(F.struct("around_size", "around"))["around"].alias("parent"))
    return sized.drop("leaves").join(parents, "split", "left")


def newick(splits: Sequence[tuple[str, float, str | None]], names: Sequence[str]) -> str:
    """Newick text of a consensus tree from (split, support, parent) and all leaves; support in per cent stands behind each node. Its
    size is that of one tree."""
    children: dict[str | None, list[str]] = {}
    support = {s: x for s, x, _ in splits}
    for split, _, parent in splits:
        children.setdefault(parent, []).append(split)
    inside = {s: set(s.split(",")) for s in support}

    def write(node: str | None) -> str:
        own = children.get(node, [])
        below = {leaf for c in own for leaf in inside[c]}
        parts = [*((min(inside[c]), write(c)) for c in own), *((leaf, leaf) for leaf in (set(names) if node is None else inside[node]) - below)]
        text = ",".join(t for _, t in sorted(parts))
        return f"({text}){support[node]:g}" if node is not None else f"({text})"

    return f"{write(None)};"


def consensus_tree(trees: DataFrame, names: DataFrame, name: str = "id", least: float = 50.0) -> str:
    """The majority-rule tree of all replicates as Newick text with support."""
    rows = [(r.split, r.support, r.parent) for r in consensus_splits(trees, least).collect()]  # fewer than there are leaves
    return newick(rows, [r[0] for r in names.select(name).distinct().collect()])


def merge_stockholm(lines: DataFrame, stem: Column) -> DataFrame:
    """Lines of Stockholm files (file, line, value) with a line that names the family by its stem after the first."""
    rest = lines.where(~((F.col("line") == 0) & F.col("value").startswith("# STOCKHOLM 1.0"))).select("file", "line", "value")
    head = lines.select("file", stem.alias("stem")).distinct().select("file", F.explode(F.array(F.struct(F.lit(-2).alias("line"), F.lit("# STOCKHOLM 1.0").alias("value")), F.struct(F.lit(-1).alias("line"), F.concat(F.lit("#=GF ID "), "stem").alias("value")))).alias("h")).select("file", "h.*")
    return head.unionByName(rest)
