"""Enumerations and fixed word tables."""

from __future__ import annotations

# Enumerations of the data model.
TRANSACTIONS = ("SALE", "RENT", "AUCTION")
PROPERTY_TYPES = ("APARTMENT", "HOUSE", "PENTHOUSE", "COMMERCIAL_ROOM", "COMMERCIAL", "OTHER")
RUN_STATUS = ("RUNNING", "COMPLETED", "PARTIAL", "SUSPECT", "FAILED")
RUN_TYPE = ("FULL", "INCREMENTAL")
PRESENCE = ("ACTIVE", "STALE", "INACTIVE")
REQUEST_STATUS = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
EVENTS = ("PRICE_CHANGED", "LISTING_REACTIVATED", "LISTING_INACTIVATED")
OUTBOX_OPERATIONS = ("UPSERT", "DELETE")
DOCUMENT_STATUS = ("ACTIVE", "INACTIVE", "REMOVED")
REVIEW_STATUS = ("PENDING", "GROUPED", "SEPARATED")

# Labels of property types.
TYPE_LABELS = {
    "APARTMENT": "Apartamento",
    "HOUSE": "Casa",
    "PENTHOUSE": "Cobertura",
    "COMMERCIAL_ROOM": "Sala comercial",
    "COMMERCIAL": "Imóvel comercial",
    "OTHER": "Imóvel",
}

# Words of property types and transactions in documents.
ALIASES = {
    "APARTAMENTO": "APARTMENT",
    "CASA": "HOUSE",
    "COMERCIAL": "COMMERCIAL",
    "SALA": "COMMERCIAL",
    "LOJA": "COMMERCIAL",
    "VENDA": "SALE",
    "AUCTION": "AUCTION",
    "LEILAO": "AUCTION",
    "ALIENACAO": "AUCTION",
    "ALUGUEL": "RENT",
    "LOCACAO": "RENT",
}

# State names in search addresses.
STATE_SLUGS = {
    "AC": "acre", "AL": "alagoas", "AP": "amapa", "AM": "amazonas", "BA": "bahia", "CE": "ceara", "DF": "distrito-federal",
    "ES": "espirito-santo", "GO": "goias", "MA": "maranhao", "MT": "mato-grosso", "MS": "mato-grosso-do-sul", "MG": "minas-gerais",
    "PA": "para", "PB": "paraiba", "PR": "parana", "PE": "pernambuco", "PI": "piaui", "RJ": "rj", "RN": "rio-grande-do-norte",
    "RS": "rio-grande-do-sul", "RO": "rondonia", "RR": "roraima", "SC": "santa-catarina", "SP": "sp", "SE": "sergipe", "TO": "tocantins",
}

# First words of streets.
STREET_WORDS = {"r": "rua", "av": "avenida", "al": "alameda", "rod": "rodovia", "tv": "travessa", "pca": "praca"}

# Messages of recovered and of expired searches.
RECOVERED = "Worker interrompido: pesquisa recuperada automaticamente."
EXPIRED = "Pesquisa expirada automaticamente: o coletor não iniciou ou parou de responder dentro do tempo limite."
