"""Word lists of linking and categorising, as the results to match need them. All are defaults of parameters."""

# Acronym: long form, symbol, kind. A capital beta is Greek: upper case of the usual spelling with a small one.
ACRONYMS = {
    "AD": ("Alzheimer's disease", None, "disease"), "PD": ("Parkinson's disease", None, "disease"), "ALS": ("amyotrophic lateral sclerosis", None, "disease"),
    "FTD": ("frontotemporal dementia", None, "disease"), "MS": ("multiple sclerosis", None, "disease"), "IBD": ("inflammatory bowel disease", None, "disease"),
    "UC": ("ulcerative colitis", None, "disease"), "CD": ("Crohn's disease", None, "disease"), "RA": ("rheumatoid arthritis", None, "disease"),
    "SLE": ("systemic lupus erythematosus", None, "disease"), "OA": ("osteoarthritis", None, "disease"), "COPD": ("chronic obstructive pulmonary disease", None, "disease"),
    "CKD": ("chronic kidney disease", None, "disease"), "CHF": ("congestive heart failure", None, "disease"), "MI": ("myocardial infarction", None, "disease"),
    "TBI": ("traumatic brain injury", None, "disease"), "ICH": ("intracerebral hemorrhage", None, "disease"), "AIS": ("acute ischemic stroke", None, "disease"),
    "HCC": ("hepatocellular carcinoma", None, "disease"), "NAFLD": ("non-alcoholic fatty liver disease", None, "disease"), "NASH": ("non-alcoholic steatohepatitis", None, "disease"),
    "ARDS": ("acute respiratory distress syndrome", None, "disease"), "ADEM": ("acute disseminated encephalomyelitis", None, "disease"), "ANE": ("acute necrotizing encephalopathy", None, "disease"),
    "HIV": ("human immunodeficiency virus infection", None, "disease"), "TB": ("tuberculosis", None, "disease"), "COVID19": ("COVID-19", None, "disease"),
    "BBB": ("blood–brain barrier", None, "anatomy"), "BCSFB": ("blood–cerebrospinal fluid barrier", None, "anatomy"), "CNS": ("central nervous system", None, "anatomy"),
    "PNS": ("peripheral nervous system", None, "anatomy"), "PBMC": ("peripheral blood mononuclear cell", None, "cell"), "DC": ("dendritic cell", None, "cell"),
    "NK": ("natural killer cell", None, "cell"), "NSC": ("neural stem cell", None, "cell"), "NPC": ("neural progenitor cell", None, "cell"),
    "OPC": ("oligodendrocyte progenitor cell", None, "cell"), "RPE": ("retinal pigment epithelium", None, "cell"), "HUVEC": ("human umbilical vein endothelial cell", None, "cell"),
    "BMEC": ("brain microvascular endothelial cell", None, "cell"), "HBMEC": ("human brain microvascular endothelial cell", None, "cell"), "M1": ("M1 macrophage", None, "cell"),
    "M2": ("M2 macrophage", None, "cell"), "TREG": ("regulatory T cell", None, "cell"), "ELISA": ("enzyme-linked immunosorbent assay", None, "assay"),
    "RT-PCR": ("reverse transcription polymerase chain reaction", None, "assay"), "QPCR": ("quantitative polymerase chain reaction", None, "assay"), "WB": ("western blot", None, "assay"),
    "IF": ("immunofluorescence", None, "assay"), "IHC": ("immunohistochemistry", None, "assay"), "FACS": ("fluorescence-activated cell sorting", None, "assay"),
    "RNA-SEQ": ("RNA sequencing", None, "assay"), "SCRNA-SEQ": ("single-cell RNA sequencing", None, "assay"), "WGS": ("whole-genome sequencing", None, "assay"),
    "WES": ("whole-exome sequencing", None, "assay"), "MRI": ("magnetic resonance imaging", None, "assay"), "FMRI": ("functional magnetic resonance imaging", None, "assay"),
    "PET": ("positron emission tomography", None, "assay"), "CT": ("computed tomography", None, "assay"), "EEG": ("electroencephalography", None, "assay"),
    "MEG": ("magnetoencephalography", None, "assay"), "IL1B": ("interleukin-1 beta", "IL1B", "gene"), "IL6": ("interleukin-6", "IL6", "gene"),
    "TNF": ("tumor necrosis factor", "TNF", "gene"), "TNF-A": ("tumor necrosis factor alpha", "TNF", "gene"), "IFN-G": ("interferon gamma", "IFNG", "gene"),
    "TGFB": ("transforming growth factor beta 1", "TGFB1", "gene"), "VEGF": ("vascular endothelial growth factor A", "VEGFA", "gene"), "EGF": ("epidermal growth factor", "EGF", "gene"),
    "EGFR": ("epidermal growth factor receptor", "EGFR", "gene"), "BDNF": ("brain-derived neurotrophic factor", "BDNF", "gene"), "APP": ("amyloid precursor protein", "APP", "gene"),
    "MAPT": ("microtubule associated protein tau", "MAPT", "gene"), "SNCA": ("alpha-synuclein", "SNCA", "gene"), "AT1R": ("angiotensin II receptor type 1", "AGTR1", "gene"),
    "AT2R": ("angiotensin II receptor type 2", "AGTR2", "gene"), "ACE2": ("angiotensin-converting enzyme 2", "ACE2", "gene"), "ACE": ("angiotensin-converting enzyme", "ACE", "gene"),
    "TMPRSS2": ("transmembrane serine protease 2", "TMPRSS2", "gene"), "MTOR": ("mechanistic target of rapamycin", "MTOR", "gene"), "AMPK": ("AMP-activated protein kinase", None, "pathway"),
    "NF-KB": ("nuclear factor kappa-light-chain-enhancer of activated B cells", None, "pathway"), "ANG I": ("angiotensin I", None, "chemical"), "ANG II": ("angiotensin II", None, "chemical"),
    "ANG 1-7": ("angiotensin-(1-7)", None, "chemical"), "ANG 1-9": ("angiotensin-(1-9)", None, "chemical"), "A\u0392": ("amyloid beta", None, "chemical"), "DA": ("dopamine", None, "chemical"),
    "5-HT": ("serotonin", None, "chemical"), "NE": ("norepinephrine", None, "chemical"), "NO": ("nitric oxide", None, "chemical"), "ROS": ("reactive oxygen species", None, "chemical"),
    "RNS": ("reactive nitrogen species", None, "chemical"), "AE": ("adverse event", None, "clinical"), "SAE": ("serious adverse event", None, "clinical"), "ADR": ("adverse drug reaction", None, "clinical"),
    "QOL": ("quality of life", None, "clinical"), "ICU": ("intensive care unit", None, "clinical"), "CRS": ("cytokine release syndrome", None, "clinical"), "CSS": ("cytokine storm syndrome", None, "clinical"),
}

# Kind of an acronym: group of the entity.
KIND_GROUPS = {
    "disease": "disease_disorder", "assay": "assay_device_procedure", "cell": "anatomy_tissue_cell", "anatomy": "anatomy_tissue_cell",
    "gene": "gene_protein", "chemical": "chemical_drug", "clinical": "phenotype_sign_symptom", "pathway": "pathway_process",
}

# Group: vocabularies that are asked first.
FIRST_CHOICE = {
    "gene_protein": ("hgnc", "pr", "so", "go"),
    "chemical_drug": ("chebi", "rxnorm", "chembl", "ncit"),
    "phenotype_sign_symptom": ("hp", "ncit", "mesh"),
    "disease_disorder": ("mondo", "doid", "efo", "ncit", "mesh"),
    "anatomy_tissue_cell": ("uberon", "cl", "fma"),
    "pathway_process": ("reactome", "go"),
    "assay_device_procedure": ("obi", "ncit"),
    "variant_hgvs": ("so", "clinvar", "dbsnp"),
    "organism_taxon": ("ncbitaxon",),
}

# Group: vocabularies that are asked where the first give few.
SECOND_CHOICE = {
    "gene_protein": ("efo", "ncit", "mesh", "obi", "wikidata", "uniprot", "mygene"),
    "chemical_drug": ("mesh", "efo", "wikidata"),
    "phenotype_sign_symptom": ("efo", "doid", "wikidata"),
    "disease_disorder": ("icd10", "wikidata"),
    "anatomy_tissue_cell": ("ncit", "mesh", "efo", "wikidata"),
    "pathway_process": ("ncit", "wikidata"),
    "assay_device_procedure": ("efo", "mesh", "wikidata"),
    "variant_hgvs": ("ncit", "wikidata"),
    "organism_taxon": ("wikidata", "mesh"),
}

# Group: vocabularies whose terms go before others that are as good, in order.
AUTHORITIES = {
    "gene_protein": ("NCBIGene", "HGNC", "PR", "UniProt"),
    "chemical_drug": ("CHEBI", "RxNorm", "ChEMBL", "NCIT", "MeSH"),
    "phenotype_sign_symptom": ("HP", "NCIT", "MeSH"),
    "disease_disorder": ("MONDO", "EFO", "DOID", "NCIT", "MeSH"),
    "anatomy_tissue_cell": ("UBERON", "CL", "FMA", "NCIT"),
    "pathway_process": ("REACTOME", "GO", "NCIT"),
    "assay_device_procedure": ("OBI", "NCIT", "EFO"),
    "variant_hgvs": ("ClinVar", "dbSNP", "SO"),
    "organism_taxon": ("NCBITaxon", "MeSH"),
}

# Group: what it adds to the threshold.
THRESHOLD_OFFSETS = {
    "gene_protein": 0.1,
    "chemical_drug": -0.03,
    "phenotype_sign_symptom": -0.05,
    "disease_disorder": 0.0,
    "anatomy_tissue_cell": 0.05,
    "pathway_process": 0.0,
    "assay_device_procedure": 0.05,
    "variant_hgvs": 0.05,
    "organism_taxon": -0.05,
}

# Groups of mentions that are no known acronym: the first pattern that is found gives the group. A pattern is looked for in the mention
# as it is written, in its canonical form, in the canonical form of one written in capitals, or in its context in lower case.
GROUP_PATTERNS = (
    ("chemical_drug", "written", r"(?i)^ang(iotensin)?[\s\-_]?(ii|iv|i|1-7|1-9)$"),
    ("chemical_drug", "canonical", r"(?i)^ang(iotensin)?[\s\-_]?(ii|iv|i|1-7|1-9)$"),
    ("variant_hgvs", "canonical", r"^rs\d+$|^[cnpgrm]\."),
    ("gene_protein", "capitals", r"^[a-z]{2,6}\d{0,3}$"),
    ("gene_protein", "canonical", r"ase$|protein$|^il\d+$"),
    ("anatomy_tissue_cell", "canonical", r"cells?$|barrier"),
    ("chemical_drug", "canonical", r"mg|mol|mmol|ic50|ec50|(ate|ide|ine|ol|one|ium)$"),
    ("pathway_process", "canonical", r"pathway|signaling|signalling|cascade|process"),
    ("assay_device_procedure", "canonical", r"assay|elisa|western blot|rt-pcr|pcr|immunostain|flow cytometry|facs|sequencing"),
    ("organism_taxon", "canonical", r"sars-cov-2|influenza"),
    ("organism_taxon", "context", r"strain|isolate|lineage|subspecies|variant"),
    ("phenotype_sign_symptom", "canonical", r"fever|pain|fatigue|hypoxia|dyspnea|phenotype|abnormality"),
    ("disease_disorder", "canonical", r"disease|syndrome|infection|cancer|carcinoma|diabetes|covid-19"),
    ("anatomy_tissue_cell", "canonical", r"cell|neuron|tissue|organ|epithelium|endothelium"),
)
DEFAULT_GROUP = "disease_disorder"

# How a mention says that a protein is phosphorylated, and how a text gives a long form with its short one.
PHOSPHO = r"(?i)^(?:pp|p|phospho)[\s-]*([A-Za-z][A-Za-z0-9-]+)"
PHOSPHO_FORMS = ("{}", "phosphorylated {}", "{} phosphorylation")
BRACKETED = r"([A-Za-z][A-Za-z0-9\s-]{2,})\s*\(\s*([A-Z][A-Za-z0-9-]{1,10})\s*\)"

NOISY = ("gsso", "enm", "omit", "ror")
GENERIC_LABELS = ("activation", "expression", "receptor", "disruption", "leakage", "dysfunction", "invasion", "accumulation", "breakdown", "damage")

# Phrases by which a model's answer is a refusal.
REFUSALS = ("i cannot", "i can't", "i am unable", "content policy", "i apologize", "i'm sorry", "inappropriate")

# Category: seed words.
CATEGORIES = {
    "Viral Entry and Neuroinvasion": ("neuroinvasion", "receptor", "ACE2", "blood-brain barrier", "BBB", "virus entry", "olfactory", "retrograde transport", "endocytosis", "direct invasion", "cranial nerve", "neural pathway", "transcribrial", "neurotropic", "trans-synaptic", "neuronal route", "olfactory nerve", "hematogenous", "choroid plexus", "neuronal transmission", "entry into CNS"),
    "Immune and Inflammatory Response": ("immune", "cytokine", "inflammation", "interferon", "TNF", "IL-6", "IL6", "cytokine storm", "immune response", "inflammatory mediators", "macrophage", "microglia", "neutrophil", "lymphocyte", "innate immunity", "immune dysregulation", "chemokine", "T cell", "NLRP3", "antibody", "immune activation", "immune imbalance", "immune-mediated", "complement"),
    "Neurodegenerative Mechanisms": ("neurodegeneration", "protein aggregation", "apoptosis", "cell death", "synaptic loss", "neurotoxicity", "oxidative stress", "mitochondrial dysfunction", "tau", "amyloid", "α-synuclein", "prion", "demyelination", "neuron loss", "misfolded proteins", "chronic neuronal damage", "neurodegenerative", "neuroinflammation"),
    "Vascular Effects": ("stroke", "thrombosis", "vascular", "ischemia", "coagulation", "blood clot", "microthrombi", "endothelial", "vasculitis", "hemorrhage", "blood vessel", "vascular damage", "capillary", "clotting", "hypoperfusion", "angiopathy", "vasculopathy"),
    "Psychological and Neurological Symptoms": ("cognitive", "memory", "fatigue", "depression", "anxiety", "brain fog", "psychiatric", "mood", "confusion", "neuropsychiatric", "emotional", "behavioral", "neurocognitive", "insomnia", "psychosocial", "attention", "motivation", "executive function", "suicidality"),
    "Systemic Cross-Organ Effects": ("lungs", "liver", "kidney", "systemic", "multi-organ", "gastrointestinal", "heart", "cardiovascular", "endocrine", "renal", "pancreas", "organ failure", "liver damage", "pulmonary", "myocardial", "respiratory", "hypoxia", "oxygen deprivation", "fibrosis"),
}
