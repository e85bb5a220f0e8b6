"""Seed registry of taxon roles."""

# Taxon, role, mimicry system, reference source.
SEED_ROLES = [
    ("ant", "model", None, "Shamble et al. 2017 Dryad fd612; Zeng et al. 2023"),
    ("Lasius", "model", None, "Shamble et al. 2017 Dryad fd612"),
    ("Crematogaster egidyi", "model", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Meranoplus bicolor", "model", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Technomyrmex sp.", "model", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Polyrhachis jianghuaensis", "model", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Polyrhachis dives", "model", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Siler collingwoodi", "mimic", "siler_southeast_asia", "10.1016/j.isci.2023.106653"),
    ("Myrmarachne formicaria", "mimic", "myrmarachnini", "10.5061/dryad.fd612"),
    ("Phintelloides versicolor", "phylogenetic_control", None, "10.1016/j.isci.2023.106653"),
    ("Salticus senicus", "phylogenetic_control", None, "10.5061/dryad.fd612"),
]


#: The registry's columns: a seed row fills the first four; curated rows say what the judgement rests on.
ROLE = "taxon string, role string, system string, source string, putative_model_taxon string, mimicry_evidence string, evidence_kind string, confidence double, lineage_note string"


def seed_roles(spark):
    return spark.createDataFrame([(*r, None, None, None, 0.0, None) for r in SEED_ROLES], ROLE)
