"""Command line: python -m flowsieve.cli run --input edges.parquet --out-prefix results/x [--value bytes] [--top-k 20]
                 python -m flowsieve.cli synth --out edges.parquet --edges 5000 --regime hotspot
                 python -m flowsieve.cli sweep --kind width|capacity --edges 100000
                 python -m flowsieve.cli experiment --kind KIND [--input edges.parquet ...] [--regimes hotspot uniform] [--out folder]"""

from __future__ import annotations

import argparse
import json


def build() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="flowsieve")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="summary, heaviest pairs and strengths of an edge table")
    run.add_argument("--input", required=True)
    run.add_argument("--out-prefix", required=True)
    run.add_argument("--value", default="bytes")
    run.add_argument("--top-k", type=int, default=20)
    synth = sub.add_parser("synth", help="write synthetic edges")
    synth.add_argument("--out", required=True)
    synth.add_argument("--edges", type=int, default=5000)
    synth.add_argument("--sources", type=int, default=512)
    synth.add_argument("--destinations", type=int, default=512)
    synth.add_argument("--regime", default="hotspot")
    synth.add_argument("--seed", type=int, default=7)
    sweep = sub.add_parser("sweep", help="sketch accuracy over widths or capacities")
    sweep.add_argument("--kind", choices=("width", "capacity"), default="width")
    sweep.add_argument("--edges", type=int, default=100_000)
    sweep.add_argument("--regime", default="hotspot")
    experiment = sub.add_parser("experiment", help="the experiments over edge files and generated regimes; a row of JSON each")
    experiment.add_argument("--kind", choices=("identifiable", "priced", "router", "formula", "smoke", "trace", "dyadic", "phase", "anomaly", "select", "certify", "benchmark"), required=True)
    experiment.add_argument("--input", nargs="*", default=[])
    experiment.add_argument("--regimes", nargs="*", default=["hotspot"])
    experiment.add_argument("--edges", type=int, default=100_000)
    experiment.add_argument("--labels", type=int, default=4096)
    experiment.add_argument("--seed", type=int, default=31)
    experiment.add_argument("--top-k", type=int, default=20)
    experiment.add_argument("--window", type=int, default=5000)
    experiment.add_argument("--out", default="", help="folder for files that an experiment writes")
    return parser


def _sources(args, spark) -> dict:
    """Edge files by name, then the generated regimes, each with positions in order."""
    from pyspark.sql import functions as F

    from .operators.ordering import with_sequence
    from .sources import edges, synthetic

    out = {}
    for path in args.input:
        df = edges.read_edges(spark, path)
        out[path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]] = df if "seq" in df.columns else with_sequence(df, ["src", "dst", "weight"])
    for regime in args.regimes:
        out[regime] = edges.normalise(synthetic.make_edges(spark, args.edges, args.labels, args.labels, regime, args.seed + args.edges + len(regime)))
    return out


def _experiment(args, spark) -> list:
    """Frames whose rows are the experiment's results."""
    from pyspark.sql import functions as F

    from .operators import pricing
    from .operators.pairs import aggregate_pairs
    from .plans import sweeps

    k, kind = args.top_k, args.kind
    if kind == "anomaly":
        return [sweeps.anomaly_ranking(spark, n=args.edges, labels=args.labels)[1]]
    if kind == "benchmark":
        return list(sweeps.benchmark(spark, (args.edges,), tuple(args.regimes), 2).values())
    sources = _sources(args, spark)
    each = lambda f: [f(e).withColumn("source", F.lit(n)) for n, e in sources.items()]
    if kind == "identifiable":
        return [sweeps.identifiable_recall(sources, k)]
    if kind in ("priced", "router"):
        bounds = None
        for name, e in sources.items():
            rows = sweeps.certify(e, name, args.window, k)["certificates"].where("alpha = 0.1").select("source", "bound").distinct()
            bounds = rows if bounds is None else bounds.unionByName(rows)
        if kind == "router":
            return [sweeps.router(sources, bounds)]
        return [sweeps.priced_recall(sources, pricing.price(bounds.withColumnRenamed("bound", "gap")), k)]
    if kind == "formula":
        return each(lambda e: sweeps.formula_comparison(aggregate_pairs(e)))
    if kind == "smoke":
        return [sweeps.format_smoke(aggregate_pairs(e), f"{args.out or 'out'}/{n}_matrix").withColumn("source", F.lit(n)) for n, e in sources.items()]
    if kind == "trace":
        return [frame for e in sources.values() for frame in sweeps.trace_experiment(e, args.edges // 2, k)]
    if kind == "certify":
        return [frame for n, e in sources.items() for name, frame in sweeps.certify(e, n, args.window, k).items() if name != "scores"]
    return each({"dyadic": lambda e: sweeps.dyadic_comparison(e, k), "phase": lambda e: sweeps.phase_points(e, k=k), "select": lambda e: sweeps.select_and_certify(e, args.edges // 2, k)}[kind])


def main(argv: list[str] | None = None, spark=None) -> None:
    args = build().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    from .operators.pairs import aggregate_pairs
    from .plans import sweeps
    from .sources import edges, sinks, synthetic

    if args.command == "run":
        pairs = aggregate_pairs(edges.read_edges(spark, args.input, args.value))
        print("\n".join(sinks.save_analysis(args.out_prefix, pairs, args.top_k)))
    elif args.command == "synth":
        df = synthetic.make_edges(spark, args.edges, args.sources, args.destinations, args.regime, args.seed)
        synthetic.write_edges(df, args.out)
    elif args.command == "experiment":
        for frame in _experiment(args, spark):
            for r in frame.collect():  # a row for each setting or source
                print(json.dumps(r.asDict(), default=str))
    else:
        df = edges.normalise(synthetic.make_edges(spark, args.edges, 4096, 4096, args.regime, 43))
        rows = sweeps.width_sweep(df) if args.kind == "width" else sweeps.capacity_sweep(df)
        for r in rows.collect():
            print(json.dumps(r.asDict()))


if __name__ == "__main__":
    main()
