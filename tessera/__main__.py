"""``python -m tessera experiment``: alignment error against noise on synthetic patches."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.operators.affine import apply_frames
from tessera.operators.alignment import get_aligner
from tessera.operators.metrics import noise_profile
from tessera.operators.synthetic import add_noise, cluster_points, random_frames, random_patches


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("command", choices=["experiment"])
    parser.add_argument("--dim", type=int, default=2)
    parser.add_argument("--patches", type=int, default=10)
    parser.add_argument("--clusters", type=int, default=5)
    parser.add_argument("--max-size", type=int, default=200)
    parser.add_argument("--max-noise", type=float, default=0.1)
    parser.add_argument("--steps", type=int, default=3)
    parser.add_argument("--methods", default="sync,weighted,svd")
    parser.add_argument("--seed", type=int, default=1)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    points = cluster_points(spark, args.dim, args.clusters, args.max_size, seed=args.seed).select("node", "coords")
    patches = random_patches(points, args.patches, 3, seed=args.seed)
    frames = random_frames(list(range(args.patches)), args.dim, seed=args.seed)
    levels = [args.max_noise * k / max(1, args.steps - 1) for k in range(args.steps)]
    methods = {n: (lambda p, n=n: get_aligner(n, p, dim=args.dim)) for n in args.methods.split(",")}
    table = noise_profile(methods, points, patches, args.dim, levels, lambda p, s: apply_frames(add_noise(p, s, args.seed), frames), scale=True)
    print(table.to_string(index=False))


if __name__ == "__main__":
    main()
