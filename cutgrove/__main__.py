"""python -m cutgrove: lists and runs queries, solves problems on disk, and runs the workflow on a volume.

    list
    run NAME --sf DIR --out PATH
    solve --edges PATH [--lifted PATH] --solver NAME --out PATH          edges(u, v, cost) -> (node, label)
    segment --voxels PATH [--train PATH] --mode 2d|anisotropic|isotropic --out PATH   voxels(x, y, z, raw, pm, seg, gt) -> (x, y, z, label)
    segment --raw DIR --map DIR [--gt DIR] [--segmentation DIR] ...      the same from folders of TIFF slices

PATH.arrays is a folder of array chunks, PATH.tif a folder of TIFF slices (--out), anything else Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("cutgrove", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("--sf", required=True)
    solve = commands.add_parser("solve")
    solve.add_argument("--edges", required=True)
    solve.add_argument("--lifted")
    solve.add_argument("--solver", default="kl")
    segment = commands.add_parser("segment")
    segment.add_argument("--voxels")
    for layer in ("raw", "map", "gt", "segmentation"):
        segment.add_argument(f"--{layer}", help="a folder of TIFF slices")
    segment.add_argument("--train", help="voxels to learn on; without it the outer 20 % on either side along z")
    segment.add_argument("--mode", choices=("2d", "anisotropic", "isotropic"), default="anisotropic")
    for p in (run, solve, segment):
        p.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "segment" and not args.voxels and not (args.raw and args.map):
        parser.error("segment needs --voxels, or --raw and --map")

    from cutgrove.plans.registry import QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    from cutgrove.operators import learning, multicut, workflows
    from cutgrove.sources import inputs

    if args.command == "run":
        out = QUERIES[args.name](spark, args.sf)
    elif args.command == "solve":
        out = multicut.solve(spark.read.parquet(args.edges), args.solver, spark.read.parquet(args.lifted) if args.lifted else None)
    else:
        test = inputs.read_volume(spark, args.voxels) if args.voxels else inputs.from_slices(spark, args.raw, args.map, args.gt, args.segmentation)
        train = [inputs.read_volume(spark, args.train)] if args.train else None
        if train is None:
            low, test, high = learning.z_cutouts(test)
            train = [low, high]
        if args.mode == "2d":
            from pyspark.sql import functions as F

            p = learning.learn_and_predict(train, test, in_plane=True)
            labels = workflows.slicewise(workflows.costs(p, scheme="none"), test.groupBy("seg").agg(F.max("z").alias("z")))
        else:
            labels = workflows.multicut_workflow(train, test, scheme="z" if args.mode == "anisotropic" else "none")
        inputs.write_labels(test.join(labels.withColumnRenamed("node", "seg"), "seg").select("x", "y", "z", "label"), args.out)
        return 0
    out.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
