"""image, pdf and batch from a command line; see --help."""

import argparse
import json

from .config import DIALECTS
from .operators import model


def main(args=None, spark=None, make_session=None) -> int:
    p = argparse.ArgumentParser(prog="leafscan")
    p.add_argument("verb", choices=["image", "pdf", "batch", "runtime"])
    p.add_argument("input", nargs="?")
    p.add_argument("--weights")
    p.add_argument("--charset")
    p.add_argument("--dialect", choices=DIALECTS, default="flat")
    p.add_argument("--format", choices=["text", "json"], default="text")
    p.add_argument("--output")
    a = p.parse_args(args)
    if a.verb == "runtime":
        print(f"onnxruntime {model.runtime_version() or 'not installed'}")
        return 0
    if not a.input or not a.charset:
        p.error("an input and a charset are needed")
    from pyspark.sql import SparkSession

    from .plans import read
    from .sources.files import read_charset

    spark = spark or SparkSession.builder.getOrCreate()
    engine = read.Engine(spark, read_charset(spark, a.charset), a.weights, make_session, DIALECTS[a.dialect])
    rows = engine.read_pdfs(a.input) if a.verb == "pdf" else engine.outcomes(a.input)
    if a.output:
        write = read.write_json if a.format == "json" or a.verb == "pdf" else lambda df, where: read.write_text(engine.read_images(a.input), where)
        write(rows, a.output)
        return 0
    for r in rows.toLocalIterator():
        if a.format == "json":
            print(json.dumps(r.asDict(), ensure_ascii=False))
        elif a.verb == "pdf":
            for i, text in enumerate(r.pages, 1):
                print(f"--- {r.path} page {i} ---\n{text}")
        else:
            print(f"--- {r.file} ---\n{r.text if r.success else r.error}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
