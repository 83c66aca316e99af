"""Every query of the library and its SQL."""

from gneiss import q_archive, q_cellmethods, q_conformity, q_convention_faults, q_conventions, q_drs, q_experiment, q_further, q_numbers, q_records, q_roles, q_rules, q_sampling

_MODULES = [q_records, q_archive, q_rules, q_conventions, q_convention_faults, q_conformity, q_cellmethods, q_roles, q_drs, q_numbers, q_further, q_sampling, q_experiment]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
