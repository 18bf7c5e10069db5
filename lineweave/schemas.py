"""Schemas of the tables that operators exchange.

``net`` keys a network; ``seq`` is the place of a line in its network's list.  Order decides ties (first level seen, first of equal
energies, first of equal components), so it is a column and never the order of rows.
"""

from __future__ import annotations

TRANSITIONS = "net string, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string"
LEVELS = "net string, level string, energy double, unc double, n_trans int"
ENERGIES = "net string, comp int, idx int, level string, energy double"
COMPONENTS = "net string, comp int, n_levels int, idx int, level string"
UNCERTAINTIES = "net string, comp int, level string, sp_unc double, boot_unc double, unc double"
REFIT_ERRORS = "net string, level string, sample int, err double"
CORRUPTED = "net string, copy int, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string, kind tinyint, mag double, orig_upper string"
CORRECTIONS = "net string, seq long, ref string, upper string, lower string, proposed_upper string, outlier_p double, confidence double"
LINKAGES = "net string, orphan int, orphan_level string, main_level string, score double, rank int"
