"""Knobs and fixed values.

The block marked FIXED VALUES holds constants that must equal the behaviour
being reproduced (defaults, limits, text patterns, region spellings). They are
stated once, plainly, in their natural order; everything else in the package
derives from them.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the reproduced behaviour)
# ---------------------------------------------------------------------------

# Search defaults.
DEFAULT_TOP_K = 10
DEFAULT_ALPHA = 0.4
SEMANTIC_TOP_K = 5
TOP_K_MIN = 1
TOP_K_MAX = 200
CANDIDATE_FACTOR = 5          # each retriever keeps top_k * 5 candidates
MINMAX_EPS = 1e-9             # min-max range below this -> all zeros

# BM25 (Okapi, library defaults).
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# SQL guard.
SQL_DEFAULT_LIMIT = 200
SQL_MAX_LIMIT = 500

# Embedding / text budget.
EMBED_BATCH_SIZE = 128
EMBED_MAX_TOKENS = 8192
EMBED_WARN_MARGIN = 0.9
AVG_CHARS_PER_TOKEN = 4
EMBED_OUTPUT_DIM = 1999
EMBEDDING_MODEL = "text-embedding-3-large"

# ANN index list counts.
IVF_LISTS_ORDERS = 200
IVF_LISTS_COMMESSE = 100
IVF_MAX_DIM = 2000

# Text cleaning patterns (applied case-insensitively, in this order).
ARTIFACT_PATTERNS = [
    r"_x000D_",
]
INTERNAL_CODE_PATTERNS = [
    r"\(cod\. int\.[^)]+\)",
    r"s/n\s*\S+",
    r"\[[^\]]+\]",
]
LICENSE_PLATE_PATTERN = r"\btargat[oa]\s+[A-Z]{1,2}\s*\d{3}\s*[A-Z]{1,2}\b"
BOILERPLATE_PATTERNS = [
    r"con la presente vi confermiamo l[’'` ]ordine[^:]*:",
    r"ai seguenti prezzi e condizioni:?",
    r"a termine lavori verr[aà] redatto un consuntivo[^.]*\.",
]

# Region spellings folded to one canonical name (key = letters-only lower form).
REGION_NORMALIZATION = {
    "friuli venezia giulia": "Friuli Venezia Giulia",
    "friuli - venezia giulia": "Friuli Venezia Giulia",
    "emilia romagna": "Emilia-Romagna",
    "tarragona": "Tarragona",
}

# Source columns of the orders export, in file order.
RAW_SOURCE_COLUMNS = [
    "t_acquisti_cod_acquisto", "ordine_n", "data_ord", "tipo_approv", "tipologia", "tipo_contratto",
    "tipo_contratto_txt", "tipo_ordine", "richiedente", "esecutore", "scad_off", "cond_pag",
    "condiz_pagamento", "banca_appoggio", "oggetto", "descrizione", "spedizione", "data_cons",
    "luogo_cons", "resa", "cons_agg", "note", "allegati", "clausola", "data_spedizione",
    "data_invio_contratto", "data_ric_cont_firmato", "cod_ind", "fornitore", "indirizzo", "comune",
    "provincia", "cap", "regione", "nazione", "prefisso_int", "prefisso_naz", "tel", "tel2", "email",
    "sito_web", "codice_fiscale", "partita_iva", "partita_iva_naz", "importo_ordine", "cod_fatt_dati",
    "t_acquisti_dati_cod_acquisto", "posiz_num", "codice", "desc", "um", "qta", "importo_unit",
    "sconto_aumento", "importo_tot", "data_consegna",
]
RAW_DATE_COLUMNS = ["data_ord", "data_cons", "data_spedizione", "data_invio_contratto",
                    "data_ric_cont_firmato", "data_consegna"]
RAW_NUMERIC_COLUMNS = ["importo_ordine", "qta", "importo_unit", "importo_tot"]
WIDE_NUMERIC_COLUMNS = ["qta", "importo_unit"]   # not amounts: their decimals are kept
TEXT_COLUMNS = ["oggetto", "descrizione", "desc", "note"]
ID_COLUMN = "ordine_n"
VENDOR_COLUMN = "fornitore"

# Projects (commesse) export: source header -> column name.
COMMESSE_RENAME_MAP = {
    "Ditta": "ditta",
    "num commessa": "num_commessa",
    "nome commessa": "nome_commessa",
    "Settore": "settore",
    "MGO": "mgo",
    "committente": "committente",
    "ente appaltante": "ente_appaltante",
    "oggetto": "oggetto",
    "importo": "importo",
    "consegna": "consegna",
    "ultimazione": "ultimazione",
    "codice gara": "codice_gara",
    "responsabile commessa": "responsabile_commessa",
    "responsabile cantiere": "responsabile_cantiere",
    "preposti": "preposti",
}
COMMESSE_DATE_COLUMNS = ["consegna", "ultimazione"]
COMMESSE_NUMERIC_COLUMNS = ["importo"]
COMMESSE_TEXT_COLUMNS = ["oggetto_filled"]
COMMESSE_ID_COLUMN = "num_commessa"
COMMESSE_CLIENT_COLUMN = "committente"

# Filter fields accepted by the order search and the project search.
ORDER_FILTER_FIELDS = ("region", "vendor", "contract_type", "category", "order_type",
                       "date_from", "date_to", "min_amount", "max_amount")
COMMESSE_FILTER_FIELDS = ("committente", "settore", "responsabile_commessa", "responsabile_cantiere",
                          "date_from", "date_to", "min_importo", "max_importo")

# Argument aliases accepted from callers, per dataset.
ORDER_FILTER_ALIASES = {
    "importo_min": "min_amount",
    "importo_max": "max_amount",
    "amount_min": "min_amount",
    "amount_max": "max_amount",
}
COMMESSE_FILTER_ALIASES = {
    "importo_min": "min_importo",
    "importo_max": "max_importo",
    "min_amount": "min_importo",
    "max_amount": "max_importo",
}

# Result comparator: absolute tolerance or 0.1 % relative slack.
COMPARE_ABS_TOL = 1e-2
COMPARE_REL_TOL = 0.001

# Threshold ladder of the padded count questions.
AMOUNT_THRESHOLDS = [100, 250, 500, 1000, 2000, 5000, 10000, 20000]

# Prompt-size cut of serialized tool results.
TRUNCATE_JSON_CHARS = 4000

# Text preview length for labels.
TEXT_PREVIEW_CHARS = 180

# ---------------------------------------------------------------------------
# Engine knobs (not reproduced values: sized for the cluster)
# ---------------------------------------------------------------------------


@dataclass
class EngineConfig:
    # Broadcast a side only below this many rows, counted at run time.
    broadcast_row_limit: int = 200_000
    # Range partitions used by the exact quantile / row-id operators (0 = shuffle partitions).
    range_partitions: int = 0


ENGINE = EngineConfig()
