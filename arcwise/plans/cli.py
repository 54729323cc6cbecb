"""Command line: score a CSV of candidates by a method, train a learner, or run an offline stage.

    python -m arcwise.plans.cli -m stream -g graph/ -r relsim/ -d candidates.csv -o out/
    python -m arcwise.plans.cli build -d triples.nt -o graph/
    python -m arcwise.plans.cli relsim -g graph/ -o relsim/ --scheme log-tf
    python -m arcwise.plans.cli -m predpath -g graph/ -d train.csv -o model/
    python -m arcwise.plans.cli -m predpath -g graph/ -d candidates.csv --model model/ -o out/
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..operators.dictionary import encode_triples
from ..operators.relations import cooccurrence, idf_report, relational_similarity, top_similar
from ..sources.readers import read_candidates, read_graph, read_matrix, read_triples
from ..sources.writers import write_dictionary, write_flows, write_graph, write_matrix, write_scores
from .learn import PathModel, predict, train_pra, train_predpath
from .methods import LEARNERS, LINK_PREDICTION, SEARCHES, normalize, score


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arcwise", description="Score candidate facts on a knowledge graph.")
    p.add_argument("stage", nargs="?", default="score", choices=("score", "build", "relsim"))
    p.add_argument("-m", "--method", choices=(*LINK_PREDICTION, *SEARCHES, *LEARNERS))
    p.add_argument("-d", "--data", help="candidates (CSV) or, for build, triples")
    p.add_argument("-g", "--graph", help="folder of a graph")
    p.add_argument("-r", "--relsim", help="folder of relational similarities")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--model", help="with a learner: score by this trained model instead of training")
    p.add_argument("--cooc", help="for relsim: folder of stored co-occurrences, instead of counting them")
    p.add_argument("--removal", choices=("as_coded", "effective"), help="whether a candidate's own edge counts")
    p.add_argument("--directed", action="store_true")
    p.add_argument("--scheme", default="log-tf", choices=("log-tf", "max-tf"))
    p.add_argument("--relation", type=int, help="with --top: print the relations most similar to this one")
    p.add_argument("--top", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if (args.top is None) != (args.relation is None):
        parser().error("--top and --relation go together")
    spark = spark or SparkSession.builder.appName("arcwise").getOrCreate()
    if args.removal and args.method == "simrank":
        parser().error("simrank walks the whole graph; it has no --removal")
    if args.stage == "build":
        nodes, relations, edges = encode_triples(read_triples(spark, args.data))
        write_dictionary(nodes, f"{args.out}/nodes")
        write_dictionary(relations, f"{args.out}/relations")
        write_graph(KnowledgeGraph.from_edges(edges, symmetric=not args.directed), args.out)
        return 0
    graph = read_graph(spark, args.graph)
    if args.stage == "relsim":
        cooc = read_matrix(spark, args.cooc).select("r1", "r2", F.col("value").cast("long").alias("c")) if args.cooc else cooccurrence(graph)
        sims = relational_similarity(cooc, graph.n_relations, args.scheme)
        write_matrix(cooc.select("r1", "r2", F.col("c").cast("double").alias("value")), f"{args.out}/cooc")
        write_matrix(sims.select("r1", "r2", F.col("sim").alias("value")), f"{args.out}/relsim")
        write_scores(idf_report(cooc, graph.n_relations), f"{args.out}/idf")
        if args.top is not None:
            top_similar(sims, args.relation, args.top).show(args.top + 1, truncate=False)
        return 0
    if not args.method or not args.data or not args.graph:
        parser().error("scoring needs a method, candidates and a graph")
    candidates = read_candidates(spark, args.data)
    own = {"removal": args.removal} if args.removal else {}
    if args.method in LEARNERS and args.model:
        write_scores(normalize(predict(PathModel.load(spark, args.model), graph, candidates)), f"{args.out}/scores")
        return 0
    if args.method in LEARNERS:
        train = train_predpath if args.method == "predpath" else train_pra
        model = train(graph, candidates, **own)
        model.save(spark, args.out)
        print(f"{args.method}: {len(model.paths)} features, C {model.best_c:g}, AUROC {model.auc:.5f}")
        return 0
    sims = read_matrix(spark, args.relsim).select("r1", "r2", F.col("value").alias("sim")) if args.relsim else None
    out = score(args.method, graph, candidates, sims, **own)
    if args.method == "stream":
        write_flows(out, f"{args.out}/flows")
    write_scores(out, f"{args.out}/scores")
    return 0


if __name__ == "__main__":
    sys.exit(main())
