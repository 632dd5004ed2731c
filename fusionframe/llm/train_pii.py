"""Trains the tagger of personal data once: `python -m fusionframe.llm.train_pii` writes pii_tagger.json beside this file.

Weights are trained in float64 over a seeded order and rounded to four decimals. Runs of 12 or 24 digits aren't among the examples, as
the check of what a card holds counts digits.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from . import pii

EXAMPLES, STEPS, SEED = 6000, 2200, 7


def main() -> None:
    tagger = pii.train(pii.labelled_windows(EXAMPLES, SEED, runs=False), STEPS)
    weights = {k: np.round(v, 4).tolist() for k, v in sorted(tagger.p.items())}
    (Path(pii.__file__).parent / "pii_tagger.json").write_text(json.dumps({"examples": EXAMPLES, "steps": STEPS, "seed": SEED, "weights": weights}, separators=(",", ":")) + "\n")


if __name__ == "__main__":
    main()
