"""All queries of the library with the SQL that gives the same rows."""

from marketloom.operators import association, evidence, extraction, fix_plan, health, models, page_tree, peers, research, scores, search, site_rules, sites, tables, text_index, ux_model

MODULES = [association, tables, sites, peers, health, search, extraction, scores, evidence, models, page_tree, site_rules, fix_plan, text_index, ux_model, research]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
