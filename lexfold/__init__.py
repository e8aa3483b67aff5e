"""Policy text analytics on Spark: the engine's public surface.

``analyze`` segments and judges texts inside their rows; ``results`` and the
reports present what it found.  The corpus operators are in ``lexfold.llm``.
"""

from lexfold.operators.detect import RULES, Rule, analyze, any_pattern, flat_matches, results
from lexfold.operators.segment import segment

__all__ = ["RULES", "Rule", "analyze", "any_pattern", "flat_matches", "results", "segment"]
