"""A complete analysis from CSV layers: each layer alone, then all together, with result tables and the text report.

    python examples/complete_analysis.py OUT_DIR name=kind=path.csv[=sample column] ...

``kind`` is metabolomics, volatiles or proteomics. Every file has a label column ``Groups``. Layers whose sample ids
differ are paired by position with ``--positional``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blockwise.plans.workflows import MultiLayerWorkflow, SingleLayerWorkflow, summary_report  # noqa: E402
from blockwise.session import get_session  # noqa: E402
from blockwise.sources.layers import read_csv_layer, report_lines, write_results  # noqa: E402


def analyse(spark, out_dir: str, layers: list[tuple[str, str, str, str]], positional: bool = False, kind: str = "random_forest", trees: int = 500, k: int | None = None) -> list[str]:
    """Runs everything on (name, kind, path, sample column), writes the tables under ``out_dir`` and returns the lines of the report."""
    single, multi = {}, MultiLayerWorkflow()
    for name, layer_kind, path, sample in layers:
        layer = read_csv_layer(spark, path, sample_col=sample, name=name)
        work = SingleLayerWorkflow(layer_kind)
        single[name] = work.run_full_analysis(layer)
        write_results(single[name], os.path.join(out_dir, "single", name))
        multi.add_layer(name, layer, layer_kind, sample)
    results = {}
    if len(layers) > 1:
        results = multi.run_full_integration(kind=kind, trees=trees, k=k, positional=positional)
        write_results(results, os.path.join(out_dir, "multi"))
    return report_lines(summary_report(single, results.get("diablo_correlations")))


def main(args: list[str]) -> None:
    positional = "--positional" in args
    out_dir, *layers = [a for a in args if a != "--positional"]
    parsed = [(*x.split("=", 3), "sample")[:4] for x in layers]
    print("\n".join(analyse(get_session("complete analysis"), out_dir, parsed, positional)))


if __name__ == "__main__":
    main(sys.argv[1:])
