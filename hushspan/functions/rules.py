"""The 54 detection rules, in tie-break order.

A rule is `anchor` + `value` + `tail`; only the value is reported.  `any_of` and `lead` never change
what a rule matches: `any_of` are lower-case texts of which one must occur, `lead` is what has to
stand where a match starts, so that the costly boundary test runs at few positions.  `gate` names one
of GATES, a pattern that every match contains; each is tried once per text for all its rules.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    kind: str
    value: str
    anchor: str = ""
    tail: str = ""
    ignore_case: bool = False
    any_of: tuple[str, ...] = ()
    lead: str = ""
    gate: str = ""


# What a text must hold at all; those after the first are tried only where there is a digit.
GATES = {
    "digit": r"(?U)\d",
    "seven": r"(?U)\d(?:[\s.\-+()]{0,2}\d){6}",
    "letters": r"(?U)[A-Z]{2}\d",
    "dotted": r"(?U)\d\.\d",
}


# ---- Fixed values: patterns, in the order that decides ties -----------------------------------
_NO = r"(?:\s*(?:no|number|#))?\.?[:\s]+"
RULES: tuple[Rule, ...] = (
    Rule("PRIVATE_KEY",
         r"-----BEGIN (?:[A-Z][A-Z ]{0,24})?PRIVATE KEY-----"
         r"(?:(?s:.*?)-----END (?:[A-Z][A-Z ]{0,24})?PRIVATE KEY-----)?",
         any_of=("-----begin ",)),
    Rule("CREDITCARD", r"\b\d(?:[ \-]?\d){12,18}\b", lead=r"\d(?:[ \-]?\d){12}", gate="seven"),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b", lead=r"[A-Z]{2}\d", gate="letters"),
    Rule("CONNECTION_STRING",
         r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|rediss|amqps?)://"
         r"[^\s:/@]+:[^\s/@]+@[^\s/]+",
         ignore_case=True, any_of=("://",), lead="[pmra]"),
    Rule("CONNECTION_STRING", r"[A-Za-z0-9+/]{43,86}={0,2}",
         anchor=r"\b(?:AccountKey|SharedAccessKey)=",
         ignore_case=True, any_of=("accountkey=", "sharedaccesskey=")),
    Rule("APIKEY", r"[A-Za-z0-9/+=]{40}",
         anchor=r"""\baws_?secret_?access_?key\b["']?\s*[:=]\s*["']?""", tail=r"\b",
         ignore_case=True, any_of=("aws",)),
    Rule("APIKEY", r"[A-Za-z0-9._~+/\-]{16,}=*",
         anchor=r"\bauthorization:\s*bearer\s+", ignore_case=True, any_of=("authorization:",)),
    Rule("CREDENTIAL", r"""[^\s"'`,;]{8,}""",
         anchor=r"\b(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_\-]?key|access[_\-]?key"
                r"|client[_\-]?secret|auth[_\-]?token|credentials?)\b"
                r"""["']?\s*(?:=>|[:=])\s*["']?""",
         ignore_case=True, lead="[pstac]",
         any_of=("passw", "passphrase", "pwd", "secret", "token", "key", "credential")),
    Rule("US_BANK", r"\d{9}", anchor=r"\b(?:aba|routing|rtn)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("aba", "routing", "rtn"), lead="[ar]"),
    Rule("US_BANK", r"\d{6,17}", anchor=r"\b(?:account|acct)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("account", "acct"), lead="acc"),
    Rule("US_BANK", r"\d{2}[- ]?\d{2}[- ]?\d{2}", anchor=r"\b(?:sort\s*code)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("sort",), lead="sort"),
    Rule("SWIFT_BIC", r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?",
         anchor=r"\b(?i:swift|bic)(?i:\s*(?:code|no|number|#))?\.?[:\s]+", tail=r"\b",
         any_of=("swift", "bic"), lead="[SsBb\u017f]"),
    Rule("EIN", r"\d{2}-\d{7}",
         anchor=r"\b(?:ein|employer identification number|tax id)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("ein", "employer identification number", "tax id"),
         lead="(?:ein|emp|tax)"),
    Rule("DOB",
         r"\d{1,2}[/\-\.]\d{1,2}[/\-\.](?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2}|"
         r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
         r"aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
         r"\.?\s+\d{1,2},?\s+\d{4}",
         anchor=r"\b(?:dob|date of birth|birth\s?date|born(?:\s+on)?)\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("dob", "birth", "born"), lead="[db]"),
    Rule("PASSPORT", r"[A-Z0-9]{6,9}", anchor=r"\bpassport" + _NO, tail=r"\b",
         ignore_case=True, any_of=("passport",), lead="pass"),
    Rule("DRIVERS_LICENSE", r"[A-Z0-9\-]{4,13}",
         anchor=r"\b(?:driver'?s?\s+licen[cs]e|dl)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("driver", "dl"), lead="d[rl]"),
    Rule("MRZ", r"[A-Z0-9<]{9}\d[A-Z<]{3}\d{6}\d[MFX<]\d{6}\d[A-Z0-9<]{14}\d{2}",
         anchor=r"(?:^|[^A-Z0-9<])", tail=r"(?:[^A-Z0-9<]|\z)",
         lead=r"(?s:.)?[A-Z0-9<]{9}\d", gate="seven"),
    Rule("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", lead="[A-HJ-NPR-Z0-9]{17}"),
    Rule("US_ITIN", r"9\d{2}-(?:7\d|8[0-8]|9[0-24-9])-\d{4}", anchor=r"\bitin" + _NO, tail=r"\b",
         ignore_case=True, any_of=("itin",), lead="itin"),
    Rule("CA_SIN", r"\d{3}[ \-]?\d{3}[ \-]?\d{3}",
         anchor=r"\b(?:sin|social insurance)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("sin", "social insurance"), lead="s[io]"),
    Rule("UK_NHS", r"\d{3}[ \-]?\d{3}[ \-]?\d{4}", anchor=r"\bnhs" + _NO, tail=r"\b",
         ignore_case=True, any_of=("nhs",), lead="nhs"),
    Rule("UK_NINO", r"[A-Za-z]{2}\d{6}[A-Da-d]",
         anchor=r"\b(?:national insurance|nino)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("national insurance", "nino"), lead="n[ai]"),
    Rule("AU_TFN", r"\d{3}[ \-]?\d{3}[ \-]?\d{3}",
         anchor=r"\b(?:tfn|tax file number)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("tfn", "tax file number"), lead="t[fa]"),
    Rule("AADHAAR", r"\d{4}[ \-]?\d{4}[ \-]?\d{4}", anchor=r"\baadh?aar" + _NO, tail=r"\b",
         ignore_case=True, any_of=("aad",), lead="aad"),
    Rule("IT_CF", r"\b[A-Z]{6}\d{2}[ABCDEHLMPRST]\d{2}[A-Z]\d{3}[A-Z]\b", lead=r"[A-Z]{6}\d", gate="letters"),
    Rule("ES_DNI", r"\b(?:\d{8}|[XYZ]\d{7})[TRWAGMYFPDXBNJZSQVHLCKE]\b",
         lead=r"[XYZ\d]\d{7}[A-Z]", gate="seven"),
    Rule("BR_CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", lead=r"\d{3}\.\d{3}\.", gate="seven"),
    Rule("BR_CPF", r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}",
         anchor=r"\bcpf(?:\s*(?:no|number|nº|#))?\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("cpf",), lead="cpf"),
    Rule("PL_PESEL", r"\d{11}", anchor=r"\bpesel" + _NO, tail=r"\b",
         ignore_case=True, any_of=("pesel",), lead="pesel"),
    Rule("SE_PNR", r"\b\d{6}[-+]\d{4}\b", lead=r"\d{6}[-+]", gate="seven"),
    Rule("NL_BSN", r"\d{9}", anchor=r"\bbsn" + _NO, tail=r"\b",
         ignore_case=True, any_of=("bsn",), lead="bsn"),
    Rule("FR_NIR", r"[12][ .]?\d{2}[ .]?\d{2}[ .]?\d{2}[ .]?\d{3}[ .]?\d{3}[ .]?\d{2}",
         anchor=r"\b(?:nir|s[ée]curit[ée] sociale|num[ée]ro de s[ée]cu)"
                r"(?:\s*(?:no|number|n[°º]|#))?\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("nir", " sociale", "ro de s"), lead="[ns]"),
    Rule("DE_STEUER_ID", r"\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}|\d{11}",
         anchor=r"\b(?:steuer[- ]?id(?:entifikationsnummer)?|idnr|tax id)\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("steuer", "idnr", "tax id"), lead="[sit]"),
    Rule("CN_RESIDENT_ID", r"\b\d{6}(?:19|20)\d{9}[\dX]\b", lead=r"\d{6}(?:19|20)", gate="seven"),
    Rule("MRN", r"[A-Z0-9\-]{5,12}", anchor=r"\b(?:mrn|medical record)" + _NO, tail=r"\b",
         ignore_case=True, any_of=("mrn", "medical record"), lead="m[re]"),
    Rule("NPI", r"\d{10}", anchor=r"\bnpi" + _NO, tail=r"\b",
         ignore_case=True, any_of=("npi",), lead="npi"),
    Rule("DEA", r"[A-Za-z]{2}\d{7}",
         anchor=r"\bdea(?:\s*(?:no|number|reg(?:istration)?|#))?\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("dea",), lead="dea"),
    Rule("MEDICARE_MBI",
         r"[0-9][A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z][A-Za-z0-9][0-9]-?[A-Za-z]{2}[0-9]{2}",
         anchor=r"\b(?:medicare|mbi)(?:\s*(?:no|number|id|#))?\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("medicare", "mbi"), lead="m[eb]"),
    Rule("HEALTH_ID", r"[A-Z0-9\-]{6,15}",
         anchor=r"\b(?:member|subscriber|insurance|policy)\s*(?:id)?\s*(?:no|number|#)?\.?[:\s]+",
         tail=r"\b", ignore_case=True,
         any_of=("member", "subscriber", "insurance", "policy"), lead="[msip]"),
    Rule("CASE_NO", r"[A-Z0-9][A-Z0-9:\.\-]{3,19}",
         anchor=r"\b(?:case|docket|matter)\s*(?:no|number|#)?\.?[:\s]+", tail=r"\b",
         ignore_case=True, any_of=("case", "docket", "matter"), lead="[cdm]"),
    Rule("CASE_NO", r"\b\d{1,2}:\d{2}-(?:cv|cr|cm|md|mc|mj|po|sw)-\d{2,6}(?:-[A-Z]{2,4})?\b",
         any_of=(":",), lead=r"\d{1,2}:\d{2}-", gate="digit"),
    Rule("CRYPTO_WALLET",
         r"\b0x[a-fA-F0-9]{40}\b|\bbc1[ac-hj-np-z02-9]{25,62}\b|"
         r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b",
         lead="(?:0x|bc1|[13][a-km-zA-HJ-NP-Z1-9]{25})", gate="digit"),
    Rule("JWT", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
         any_of=("eyj",), lead="eyJ"),
    Rule("MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5}\b",
         any_of=(":", "-"), lead=r"[0-9A-Fa-f]{2}[:\-][0-9A-Fa-f]{2}[:\-]"),
    Rule("IPV6", r"\b[A-Fa-f0-9]{1,4}(?::[A-Fa-f0-9]{0,4}){2,7}\b",
         any_of=(":",), lead=r"[A-Fa-f0-9]{1,4}:[A-Fa-f0-9]{0,4}:"),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
         any_of=("@",), lead=r"[A-Za-z0-9._%+\-]"),
    Rule("PHONE",
         r"\b(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}\b",
         lead=r"[+(]?\d(?:[\s.\-()]{0,2}\d){9}", gate="seven"),
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", lead=r"\d{3}-\d{2}-", gate="seven"),
    Rule("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", lead=r"\d{1,3}\.\d", gate="dotted"),
    Rule("APIKEY",
         r"\b(?:sk-|sk_live_|sk_test_|pk_|rk_live_|AKIA|ASIA|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|"
         r"glpat-|xox[baprs]-|xapp-|hf_|npm_|pypi-|glsa_|dop_v1_|shpat_|shpss_|figd_|lin_api_|"
         r"tfp_)[A-Za-z0-9_\-]{10,}\b|\bAIza[0-9A-Za-z_\-]{35}\b|\bya29\.[0-9A-Za-z_\-\.]{20,}\b|"
         r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}\b",
         any_of=("sk-", "sk_", "pk_", "rk_", "akia", "asia", "gh", "glpat-", "xox", "xapp-", "hf_",
                 "npm_", "pypi-", "glsa_", "dop_", "shp", "figd_", "lin_api_", "tfp_", "aiza",
                 "ya29.", "sg."),
         lead="[sprAghxndflytS]"),
    Rule("URL", r"\bhttps?://[^\s)]+", any_of=("http",), lead="http"),
    Rule("ADDRESS",
         r"\b\d{1,5}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}\s+"
         r"(?:Street|St|Avenue|Ave|Road|Rd|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way)\b",
         lead=r"\d{1,5}\s+[A-Z]", gate="digit"),
    Rule("MONEY", r"\$\s?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$\s?\d{4,}(?:\.\d+)?", any_of=("$",)),
    Rule("EMPID", r"\bEMP-\d{4,6}\b", any_of=("emp-",), lead="EMP-"),
)
# ---- end of the fixed values ------------------------------------------------------------------

OPEN, CLOSE = "\ue000", "\ue001"
