"""Networks as text files for graph tools: edge lists, node attributes, and one GraphML document an ego network.

A network has ref_gene, gene_i, gene_j, r_low, r_high, delta, class; degrees have ref_gene, focus, degree_low, degree_high,
degree_diff (operators/keyed.py makes both). Whole-number features are written as gene_<number>.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.rules import top_of_each

from .matrix import write_table

REWIRED = ("disappear", "new", "sign_change")
HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    + "".join(f'<key id="{k}" for="node" attr.name="{k}" attr.type="{t}"/>\n' for k, t in (("is_ego", "boolean"), ("degree_low", "long"), ("degree_high", "long"), ("degree_diff", "long")))
    + "".join(f'<key id="{k}" for="edge" attr.name="{k}" attr.type="{t}"/>\n' for k, t in (("r_low", "double"), ("r_high", "double"), ("delta", "double"), ("class", "string")))
    + '<graph edgedefault="undirected">'
)
TAIL = "</graph>\n</graphml>"


def label(df: DataFrame, column: str) -> Column:
    """The name of a feature as files give it."""
    return F.col(column) if dict(df.dtypes)[column] == "string" else F.concat(F.lit("gene_"), F.col(column).cast("string"))


def edge_list(network: DataFrame, side: str, threshold: float = 1e-4) -> DataFrame:
    """ref_gene, from, to and the numbers of an edge: for side "low" or "high" r and abs_r of edges whose |r| reaches the
    threshold there, for "diff" both correlations, their difference and the class of all edges."""
    ends = [F.col("ref_gene"), label(network, "gene_i").alias("from"), label(network, "gene_j").alias("to")]
    if side == "diff":
        return network.select(*ends, "delta", "r_low", "r_high", F.abs("delta").alias("abs_delta"), "class")
    r = F.col(f"r_{side}")
    return network.where(F.abs(r) >= threshold).select(*ends, r.alias("r"), F.abs(r).alias("abs_r"))


def node_table(network: DataFrame, degrees: DataFrame) -> DataFrame:
    """Degrees and counts of rewired edges of all nodes with an edge in a reference's differential network."""
    ends = network.select("ref_gene", F.explode(F.array("gene_i", "gene_j")).alias("focus"), "class", "delta")
    counts = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in REWIRED]
    got = ends.groupBy("ref_gene", "focus").agg(*counts, F.sum(F.abs("delta")).alias("sum_abs_delta"))
    out = degrees.where("degree_diff > 0").join(got, ["ref_gene", "focus"])
    return out.select("ref_gene", label(out, "focus").alias("gene_id"), "degree_low", "degree_high", "degree_diff", *[f"n_{c}" for c in REWIRED], sum(F.col(f"n_{c}") for c in REWIRED).alias("rewiring_score"), "sum_abs_delta")


def write_lists(network: DataFrame, degrees: DataFrame, path: str, threshold: float = 1e-4) -> None:
    """Folders edges_low, edges_high, edges_diff and nodes of tab-separated text with four decimals; existing ones are an error."""
    for side in ("low", "high", "diff"):
        write_table(edge_list(network, side, threshold), f"{path}/edges_{side}")
    write_table(node_table(network, degrees), f"{path}/nodes")


def _escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def ego_graphs(network: DataFrame, degrees: DataFrame, top: int = 10) -> DataFrame:
    """ref_gene, ego, part, a, b, text: the GraphML lines of the egos with the `top` largest degree_diff of each reference.

    An ego's network is the edges among it and its neighbours. Lines in the order of part (0 head, 1 nodes, 2 edges, 3 tail),
    a and b make up the document. Ties of degree go to the smaller feature; an ego without edges has a document of one node.
    """
    egos = top_of_each(degrees, ["ref_gene"], top, F.desc("degree_diff"), "focus").select("ref_gene", F.col("focus").alias("ego"))
    ends = network.select("ref_gene", F.col("gene_i").alias("ego"), F.col("gene_j").alias("node")).union(network.select("ref_gene", "gene_j", "gene_i"))
    members = ends.join(F.broadcast(egos), ["ref_gene", "ego"], "left_semi").distinct().union(egos.select("ref_gene", "ego", F.col("ego").alias("node")))
    nodes = members.join(degrees.withColumnRenamed("focus", "node"), ["ref_gene", "node"])
    one, two = members.withColumnRenamed("node", "gene_i"), members.withColumnRenamed("node", "gene_j")
    edges = network.join(one, ["ref_gene", "gene_i"]).join(two, ["ref_gene", "ego", "gene_j"])
    data = lambda **v: [F.format_string(f'<data key="{k}">{f}</data>', c) for k, (f, c) in v.items()]
    whole = {k: ("%d", F.col(k)) for k in ("degree_low", "degree_high", "degree_diff")}
    real = {k: ("%.6f", F.col(k)) for k in ("r_low", "r_high", "delta")}
    node = F.concat(F.format_string('<node id="%s">', _escaped(label(nodes, "node"))), *data(is_ego=("%s", (F.col("node") == F.col("ego")).cast("string")), **whole), F.lit("</node>"))
    edge = F.concat(F.format_string('<edge source="%s" target="%s">', _escaped(label(edges, "gene_i")), _escaped(label(edges, "gene_j"))), *data(**real, **{"class": ("%s", F.col("class"))}), F.lit("</edge>"))
    kind = dict(degrees.dtypes)["focus"]
    none = F.lit(None).cast(kind)
    frame = egos.select("ref_gene", "ego", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(HEAD).alias("text")), F.struct(F.lit(3).alias("part"), F.lit(TAIL).alias("text")))).alias("l"))
    lines = frame.select("ref_gene", "ego", "l.part", none.alias("a"), none.alias("b"), "l.text")
    lines = lines.union(nodes.select("ref_gene", "ego", F.lit(1), "node", none, node))
    return lines.union(edges.select("ref_gene", "ego", F.lit(2), "gene_i", "gene_j", edge))


def write_ego_graphs(lines: DataFrame, path: str) -> None:
    """A folder ref_gene=.../ego=... for each ego network with its document as one text file; an existing path is an error.

    An ego's lines come to one task, which sorts them on disk if need be and writes them one by one.
    """
    placed = lines.repartition("ref_gene", "ego").sortWithinPartitions("ref_gene", "ego", "part", "a", "b")
    placed.select("ref_gene", "ego", "text").write.mode("errorifexists").partitionBy("ref_gene", "ego").text(path)
