"""The kind dimension: label, pack, confidence, egress policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind -> (label, pack, baseline confidence).
KINDS: dict[str, tuple[str, str, float]] = {
    "EMAIL": ("email", "core", 0.95),
    "PHONE": ("phone", "core", 0.75),
    "SSN": ("ssn", "core", 1.0),
    "IP": ("ip", "network", 1.0),
    "APIKEY": ("api-key", "secrets", 0.95),
    "URL": ("url", "core", 0.95),
    "ADDRESS": ("address", "core", 0.75),
    "MONEY": ("amount", "core", 0.75),
    "NAME": ("person", "core", 0.8),
    "COMPANY": ("entity", "core", 0.8),
    "EMPID": ("employee-id", "core", 0.75),
    "CREDITCARD": ("card", "payment", 1.0),
    "IBAN": ("iban", "payment", 1.0),
    "US_BANK": ("bank", "payment", 1.0),
    "SWIFT_BIC": ("swift", "payment", 1.0),
    "EIN": ("ein", "payment", 0.95),
    "JWT": ("jwt", "secrets", 0.95),
    "PRIVATE_KEY": ("private-key", "secrets", 1.0),
    "CONNECTION_STRING": ("conn-string", "secrets", 1.0),
    "CREDENTIAL": ("credential", "secrets", 0.85),
    "DOB": ("dob", "identity", 0.85),
    "PASSPORT": ("passport", "identity", 0.85),
    "DRIVERS_LICENSE": ("license", "identity", 0.85),
    "VIN": ("vin", "identity", 1.0),
    "MRZ": ("passport-mrz", "identity", 1.0),
    "US_ITIN": ("itin", "national-id", 0.95),
    "CA_SIN": ("sin", "national-id", 1.0),
    "UK_NHS": ("nhs", "national-id", 1.0),
    "UK_NINO": ("nino", "national-id", 0.85),
    "AU_TFN": ("tfn", "national-id", 1.0),
    "AADHAAR": ("aadhaar", "national-id", 1.0),
    "IT_CF": ("codice-fiscale", "national-id", 1.0),
    "ES_DNI": ("dni", "national-id", 1.0),
    "BR_CPF": ("cpf", "national-id", 1.0),
    "PL_PESEL": ("pesel", "national-id", 1.0),
    "SE_PNR": ("personnummer", "national-id", 1.0),
    "NL_BSN": ("bsn", "national-id", 1.0),
    "FR_NIR": ("nir", "national-id", 1.0),
    "DE_STEUER_ID": ("steuer-id", "national-id", 1.0),
    "CN_RESIDENT_ID": ("resident-id", "national-id", 1.0),
    "MRN": ("mrn", "medical", 0.85),
    "NPI": ("npi", "medical", 1.0),
    "DEA": ("dea", "medical", 1.0),
    "HEALTH_ID": ("member-id", "medical", 0.85),
    "MEDICARE_MBI": ("medicare-mbi", "medical", 0.95),
    "CASE_NO": ("case", "legal", 0.85),
    "CRYPTO_WALLET": ("wallet", "network", 1.0),
    "IPV6": ("ipv6", "network", 1.0),
    "MAC_ADDRESS": ("mac", "network", 0.95),
    "CUSTOM": ("custom", "core", 1.0),
    "PERSON_NER": ("person", "core", 0.8),
    "ORG_NER": ("entity", "core", 0.8),
    "CODENAME_NER": ("codename", "core", 0.8),
    "LOCATION_NER": ("location", "core", 0.8),
    "EMPID_NER": ("employee-id", "core", 0.8),
}

# Packs a user may switch off.  `core` and `secrets` never can be.
TOGGLEABLE_PACKS = ("payment", "identity", "national-id", "medical", "legal", "network")

# Kinds produced by a model rather than a pattern.
MODEL_KINDS = ("PERSON_NER", "ORG_NER", "CODENAME_NER", "LOCATION_NER", "EMPID_NER")

# Kinds that stop a message from leaving -> (rule, class, what to do).
BLOCK_POLICY: dict[str, tuple[str, str, str]] = {
    "SSN": (
        "Social Security number in outbound payload", "CRITICAL_IDENTITY",
        "SSNs are never sent to a third-party model endpoint. Remove it, or use a local model."),
    "APIKEY": (
        "Live API credential in outbound payload", "CRITICAL_SECRET",
        "An exposed API key gives access at once. Rotate it and keep secrets out of prompts."),
    "CREDITCARD": (
        "Payment card number in outbound payload", "CRITICAL_PAYMENT",
        "This card number passes its checksum. Remove it, or use a local model."),
    "IBAN": (
        "Bank account (IBAN) in outbound payload", "CRITICAL_PAYMENT",
        "Bank account numbers may not leave. Remove it, or use a local model."),
    "PRIVATE_KEY": (
        "Private key material in outbound payload", "CRITICAL_SECRET",
        "Treat this key as compromised and rotate it before going on."),
    "CONNECTION_STRING": (
        "Database credentials in outbound payload", "CRITICAL_SECRET",
        "The connection string carries a live password. Rotate it and leave it out."),
    "CREDENTIAL": (
        "Password or secret assignment in outbound payload", "CRITICAL_SECRET",
        "This looks like a live credential. Replace the value with a placeholder."),
}

CRITICAL_KINDS = tuple(BLOCK_POLICY)

SPAN_TYPE = "struct<start:int,end:int,kind:string,raw:string,alias:string,confidence:float>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def sql_list(values) -> str:
    return ",".join(f"'{v}'" for v in values)


def sql_map(column: str, mapping: dict, default: str = "NULL") -> str:
    """A literal map lookup as a CASE, which stays inside generated code."""
    groups: dict = {}
    for key, value in mapping.items():
        groups.setdefault(value, []).append(key)
    text = "CASE"
    for value, keys in groups.items():
        shown = f"'{value}'" if isinstance(value, str) else repr(value)
        text += f" WHEN {column} IN ({sql_list(keys)}) THEN {shown}"
    return f"{text} ELSE {default} END"


def label_sql(column: str) -> str:
    return sql_map(column, {k: v[0] for k, v in KINDS.items()}, "'unknown'")


def pack_sql(column: str) -> str:
    return sql_map(column, {k: v[1] for k, v in KINDS.items() if v[1] != "core"}, "'core'")


def confidence_sql(column: str) -> str:
    table = {k: v[2] for k, v in KINDS.items()}
    return f"cast({sql_map(column, table, '0.8')} as float)"


def is_critical(kind: Column) -> Column:
    return kind.isin(*CRITICAL_KINDS)


def is_model_kind(kind: Column) -> Column:
    return kind.isin(*MODEL_KINDS)


def kinds_table(spark: SparkSession) -> DataFrame:
    """All 55 kinds as a dimension; fixed size, so always safe to broadcast."""
    rows = [
        (kind, label, pack, float(conf), kind in BLOCK_POLICY, kind in MODEL_KINDS,
         *BLOCK_POLICY.get(kind, (None, None, None)))
        for kind, (label, pack, conf) in KINDS.items()
    ]
    return spark.createDataFrame(
        rows,
        "kind string, label string, pack string, base_confidence float, critical boolean,"
        " is_model boolean, rule string, class string, description string",
    )


def broadcast_kinds(spark: SparkSession) -> DataFrame:
    return F.broadcast(kinds_table(spark))
