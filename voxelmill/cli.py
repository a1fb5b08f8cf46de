"""Command line: extract patches, make reports, group features, export masks, list images that lack one, join small files."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from . import config as C
from .session import clear_written, get_session, hadoop_path


def run_metadata(folder: str, title: str, settings: str, argv: list[str]) -> Path:
    """A note of when and how a run was started, with its settings."""
    path = Path(folder) / "run_metadata.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    now = datetime.datetime.now().astimezone().isoformat(timespec="seconds")
    path.write_text(f"# {title}\n\nstarted {now} in {Path.cwd()}\n\n    {' '.join(argv)}\n\n## {settings}\n\n{Path(settings).read_text()}\n", encoding="utf-8")
    return path


def missing_masks(spark, images: str, masks: str, limit: int | None = None):
    """Images of a folder without a mask named after them, by name; with ``limit`` only the first ones."""
    from pyspark.sql import functions as F

    name = lambda p, end: F.regexp_replace(F.element_at(F.split("path", "/"), -1), end, "")
    listed = lambda p: spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(p).select("path")
    have = listed(masks).select(name(masks, r"_analysismask\.ome\.tiff?$").alias("stem"))
    lacking = listed(images).withColumn("stem", name(images, r"\.tiff?$")).join(have, "stem", "left_anti").orderBy("path")
    return lacking if limit is None else lacking.limit(limit)


def batch(folder: str, prefix: str, ids: list[int] | None, keep_on: bool, dry_run: bool, master: str | None) -> int:
    """One report for each settings file of ``folder`` whose name begins with ``prefix`` (in the order of names), or for those of the given ids.

    Ends at the first report that fails, with ``keep_on`` after all of them; how many failed is given back.
    """
    found = [Path(folder) / f"{prefix}{i}.yaml" for i in ids] if ids else sorted(Path(folder).glob(f"{prefix}*.yaml"))
    lacking = [str(p) for p in found if not p.exists()]
    if lacking or not found:
        raise ValueError(f"no settings {', '.join(lacking) or prefix + '*'} in {folder}")
    failed = 0
    for path in found:
        print(path)
        if dry_run:
            continue
        try:
            main([*(["--master", master] if master else []), "report", "--config", str(path)])
        except Exception as e:  # noqa: BLE001 - whatever ends one report must not end the others
            if not keep_on:
                raise
            failed += 1
            print(f"{path}: {e}", file=sys.stderr)
    return failed


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = argparse.ArgumentParser(prog="voxelmill", description=__doc__)
    parser.add_argument("--master")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("extract", "report"):
        one = jobs.add_parser(name)
        one.add_argument("--config", required=True)
        one.add_argument("--dry-run", action="store_true")
        if name == "report":
            one.add_argument("--features", help="Parquet table of features; without it they are computed from the crops")
            one.add_argument("--patches", help="folder of the crops, by default the one beside the manifest")
    one = jobs.add_parser("report-batch", help="one report for each settings file of a prefix")
    one.add_argument("--configs-dir", default="configs")
    one.add_argument("--config-prefix", required=True)
    one.add_argument("--clusters", type=int, nargs="*")
    one.add_argument("--continue-on-error", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one = jobs.add_parser("missing-masks")
    one.add_argument("--images", required=True)
    one.add_argument("--masks", required=True)
    one.add_argument("--limit", type=int)
    one = jobs.add_parser("mask-export", help="masks of all images that lack one, or of those named")
    one.add_argument("--images", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--limit", type=int)
    one.add_argument("--channel", type=int, default=0)
    one.add_argument("--method", default="hysteresis")
    one.add_argument("--halo", type=int, default=0)
    one.add_argument("--guided", action="store_true", help="grow the mask in the volume, weighed by the projection's mask")
    one.add_argument("--dry-run", action="store_true")
    one = jobs.add_parser("feature-variance")
    one.add_argument("--separation-csv", required=True, nargs="+")
    one.add_argument("--n-clusters", type=int)
    one.add_argument("--output", required=True)
    one = jobs.add_parser("compact")
    one.add_argument("--pattern", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--target-bytes", type=int, default=128 << 20)
    one.add_argument("--kind", choices=("raw", "lines", "zstd"), default="lines")
    args = parser.parse_args(argv)

    if args.job == "extract":
        config = C.load_dataset(args.config)
        print(f"{config.dataset_name}: {len(config.samples)} samples")
        if args.dry_run:
            return 0
        from .plans.extract import extract

        run_metadata(config.output_dir, "Patch extraction", args.config, argv)
        spark = get_session(master=args.master)
        print(extract(spark, config))
        clear_written(spark)
    elif args.job == "report":
        config = C.load_report(args.config)
        if args.dry_run:
            print("settings are in order")
            return 0
        from .plans.latent_report import image_tables, patch_features, report, write_report

        spark = get_session(master=args.master)
        path = config.manifest_path
        manifest = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
        patches = args.patches or f"{path.rstrip('/').rpartition('/')[0]}/patches"
        at, files = hadoop_path(spark, patches)
        crops = spark.read.parquet(patches) if files.exists(at) else None
        if crops is None and not args.features:
            raise ValueError(f"no table of features is given, and there are no crops in {patches} to compute them from")
        features = spark.read.parquet(args.features) if args.features else patch_features(spark, manifest, patches, config)
        run_metadata(config.output_dir, "Latent report", args.config, argv)
        tables = report(spark, manifest, features, config)
        write_report(tables, config.output_dir)
        sizes = manifest.select("patch_height_px", "patch_width_px", "z_window").distinct().collect() if crops is not None else []
        if len(sizes) == 1:  # images of different sizes have no common pixels
            h, w, z = sizes[0]
            write_report(image_tables(tables["patch_latent_report"], crops, h * w, z), config.output_dir)
        clear_written(spark)
    elif args.job == "report-batch":
        return min(batch(args.configs_dir, args.config_prefix, args.clusters, args.continue_on_error, args.dry_run, args.master), 1)
    elif args.job == "missing-masks":
        for row in missing_masks(get_session(master=args.master), args.images, args.masks, args.limit).toLocalIterator():
            print(row.path)
    elif args.job == "mask-export":
        from .plans.mask_export import MaskSettings, export_masks

        settings, spark = MaskSettings(channel=args.channel, method=args.method, halo=args.halo, guided=args.guided), get_session(master=args.master)
        Path(args.output).mkdir(parents=True, exist_ok=True)
        todo = [r.path for r in missing_masks(spark, args.images, args.output, args.limit).toLocalIterator()]  # names, which a reader of files lists on the driver anyway
        print(f"{len(todo)} images lack a mask")
        if todo and not args.dry_run:
            for row in export_masks(spark, todo, args.output, settings).toLocalIterator():
                print(row.mask_path, row.true_pixels)
        clear_written(spark)
    elif args.job == "feature-variance":
        from functools import reduce

        from pyspark.sql import functions as F

        from .operators.feature_variance import load_separation, variance_clusters

        spark = get_session(master=args.master)
        tables = [load_separation(spark, p).withColumn("source", F.lit(p)) for p in args.separation_csv]
        every = reduce(lambda a, b: a.unionByName(b), tables)
        groups = variance_clusters(every, "source", args.n_clusters)
        every.join(groups, ["source", "feature"]).write.mode("overwrite").parquet(args.output)
    else:
        from .operators.compaction import compact_folder

        spark = get_session(master=args.master)
        for row in compact_folder(spark, args.pattern, args.output, args.target_bytes, args.kind).toLocalIterator():
            print(row.file_path, row.n_bytes)
        clear_written(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
