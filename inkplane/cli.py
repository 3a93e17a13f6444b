"""Command line: clean sheets, cut views, draw what an arrow model finds, or write a data set of tiles."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time
from functools import partial


def _maker(name: str):
    """The function that `module:function` names; it makes a reader of texts, once a task."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _reader(name: str):
    return _maker(name)()


def _arrow_model(path: str):
    from .operators import models

    return models.session(path)[0]


def _clean(path, img, more, out, plot=False):
    from .operators import sheets
    from .sources import images

    done = sheets.cleaned(img, more)
    names = [images.save(f"{out}/{images.stem(path)}.png", done["clean"])]
    if plot:
        names.append(images.save(f"{out}/{images.stem(path)}_plot.png", done["plot"]))
    return {"views": len(done["views"]), "files": names}


def _views(path, img, more, out, size=None):
    from .operators import sheets
    from .sources import images

    pictures = [v["picture"] for v in sheets.cleaned(img, more)["views"]]
    if size:
        pictures = sheets.crops(pictures, size)
    return {"views": len(pictures), "files": [images.save(f"{out}/{images.stem(path)}_{k}.png", p) for k, p in enumerate(pictures)]}


def _overlay(path, img, more, out):
    from .operators import models
    from .sources import images

    if more.get("model_error"):
        raise RuntimeError(more["model_error"])
    t = time.perf_counter()
    mask = models.painted(more.get("strips"), *img.shape[:2])
    name = images.save(f"{out}/{images.stem(path)}.png", models.overlay(img, mask))
    return {"views": len(more.get("boxes") or ()), "files": [name, f"{img.shape[1]} x {img.shape[0]}, painted in {1000 * (time.perf_counter() - t):.0f} ms"]}


def main(argv: list[str] | None = None) -> int:
    """Exit code 1 if any sheet failed; the others go on."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import detections, labels, models
    from .sources import images, tables

    p = argparse.ArgumentParser(prog="inkplane")
    p.add_argument("what", choices=["clean", "views", "arrows", "dataset"])
    p.add_argument("sources", nargs="+", help="files and folders; of a data set the folder with images, labels and classes.txt")
    p.add_argument("--out", required=True, help="a folder that all tasks share")
    p.add_argument("--size", type=int, help="side of the square that a view is put on; without it views stay as they are")
    p.add_argument("--plot", action="store_true", help="also write what is removed, faded, with the views' boxes and numbers")
    p.add_argument("--arrows", help="model file of arrows, for onnxruntime")
    p.add_argument("--reader", help="module:function that makes a reader of texts")
    p.add_argument("--conf", type=float, default=0.3, help="least confidence of an arrow")
    p.add_argument("--workers", type=int, help="tasks that sheets are dealt to")
    p.add_argument("--tile", type=int, default=640, help="side of a data set's tiles; 0: whole sheets")
    p.add_argument("--val", nargs="*", help="sheets of the validation part, by name or by what follows its last dash")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "dataset":
        split = tables.make_dataset(spark, a.sources[0], a.out, tile=a.tile or None, val=a.val, overwrite=a.overwrite)
        print(f"{split['images']['train']} pictures to train with, {split['images']['val']} to validate: {a.out}/data.yaml")
        return 0
    if a.workers is not None and a.workers < 1:
        p.error("--workers must be positive")
    if a.what == "arrows" and not a.arrows:
        p.error("arrows needs --arrows")
    sheets = images.discover(spark, a.sources)
    images.one_name_each(sheets.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("name")))
    found = read = None
    if a.arrows:
        side = models.session(a.arrows)[1]
        found = models.arrows(sheets, partial(_arrow_model, os.path.abspath(a.arrows)), side, a.conf)
    if a.reader:
        read = models.texts(sheets, partial(_reader, a.reader))
    given = models.with_models(sheets, found, read)
    if a.workers:
        given = given.repartition(a.workers)
    fn = {"clean": partial(_clean, out=a.out, plot=a.plot), "views": partial(_views, out=a.out, size=a.size), "arrows": partial(_overlay, out=a.out)}[a.what]
    done = images.map_sheets(given, fn, "views int, files array<string>")
    failed = 0
    for r in detections.ordered(done).toLocalIterator():
        print(r["path"], r["error"] or f"{r['views']} {'arrows' if a.what == 'arrows' else 'views'} -> {', '.join(r['files'])}")
        failed += r["error"] is not None
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
