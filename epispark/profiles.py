"""Source profiles, code rules and the operational field guide.

Everything in this module is data. The values below must equal the
behaviour the library reproduces (labels and candidate names are part of
the output), so they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Dict, List, Sequence, Tuple

# ---------------------------------------------------------------------------
# FIXED VALUES — ICD-10 meningitis rules, code pattern, source profiles and
# field guide. Label texts are Portuguese output data; keep them verbatim.
# ---------------------------------------------------------------------------

# (grupo, prefixo, rotulo, padrao), in matching order.
CODE_RULES: Tuple[Tuple[str, str, str, str], ...] = (
    ("A170", "A170", "A170 — Meningite tuberculosa", "A170"),
    ("A390", "A390", "A390 — Meningite meningocócica", "A390"),
    ("A87", "A87", "A87 — Meningite viral", "A87*"),
    ("G00", "G00", "G00 — Meningite bacteriana", "G00*"),
    ("G01", "G01", "G01 — Meningite em doenças bacterianas classificadas em outra parte", "G01*"),
    ("G02", "G02", "G02 — Meningite em outras doenças infecciosas/parasitárias classificadas em outra parte", "G02*"),
    ("G03", "G03", "G03 — Meningite por outras causas / não especificada", "G03*"),
)

# One capture group; an optional dot between the stem and the suffix.
CODE_PATTERN = (
    r"(A17[\.]?0|A39[\.]?0|A87[\.]?[0-9A-Z]?|G00[\.]?[0-9A-Z]?"
    r"|G01[\.]?[0-9A-Z]?|G02[\.]?[0-9A-Z]?|G03[\.]?[0-9A-Z]?)"
)

NO_CODE_LABEL = "Sem CID-10 meningite detectado"
OTHER_CODE_LABEL = "Outro CID capturado"

SEX_MALE = "Masculino"
SEX_FEMALE = "Feminino"
SEX_OTHER = "Ignorado/Outro"
# Upper-cased cleaned text -> label.
SEX_CODES: Tuple[Tuple[str, str], ...] = (
    ("M", SEX_MALE),
    ("1", SEX_MALE),
    ("F", SEX_FEMALE),
    ("2", SEX_FEMALE),
    ("3", SEX_FEMALE),
    ("I", SEX_OTHER),
    ("0", SEX_OTHER),
    ("9", SEX_OTHER),
    ("IGN", SEX_OTHER),
)

AGE_MODE_AUTO = "Automático"
AGE_MODE_DIRECT = "Anos diretos"
AGE_MODE_CODED = "DATASUS codificada"
AGE_MODE_UNIT = "DATASUS com coluna de unidade"
AGE_MODES = (AGE_MODE_AUTO, AGE_MODE_DIRECT, AGE_MODE_CODED, AGE_MODE_UNIT)
# Normalised age-column names that are read as unit-coded ages.
CODED_AGE_NAMES = frozenset({"NUIDADEN", "IDADE"})

# Missingness field labels, in report order.
MISSING_LABELS = (
    "Data",
    "Sexo",
    "Idade",
    "Unidade da idade",
    "Município",
    "Desfecho/classificação",
    "Diagnóstico/CID bruto",
    "CID-10 de meningite detectado",
)

# The top-k of the standard report.
TOP_CATEGORY_N = 20
TOP_CODES_N = 30

PERIODS = {"Ano": "year", "Mês": "month", "Semana": "week"}


@dataclass(frozen=True)
class SourceProfile:
    name: str
    subtitle: str
    date: Sequence[str]
    sex: Sequence[str]
    age: Sequence[str]
    age_unit: Sequence[str]
    municipality: Sequence[str]
    outcome: Sequence[str]
    diagnosis: Sequence[str]
    codes: Sequence[str]
    notes: Sequence[str] = field(default_factory=tuple)


SINAN = SourceProfile(
    name="SINAN",
    subtitle="Notificações/casos de meningite",
    date=("DT_SIN_PRI", "DT_NOTIFIC", "DT_INVEST", "DT_ENCERRA", "DT_DIGITA"),
    sex=("CS_SEXO", "SEXO"),
    age=("NU_IDADE_N", "IDADE", "IDADE_ANOS", "IDADEANOS"),
    age_unit=(),
    municipality=("ID_MN_RESI", "ID_MUNICIP", "ID_MN_OCORR", "CODMUNRES", "CODMUNOCOR",
                  "MUNIC_RES", "MUN_RES", "MUN_OCOR"),
    outcome=("EVOLUCAO", "CLASSI_FIN", "CRITERIO"),
    diagnosis=("ID_AGRAVO", "CON_DIAGES", "CLA_ME_BAC", "CLA_ME_ASS", "CLA_ME_ETI",
               "CLASSI_FIN", "CRITERIO", "AGRAVO", "CID10", "CID"),
    codes=("ID_AGRAVO", "CID10", "CID", "AGRAVO"),
)

SIM = SourceProfile(
    name="SIM",
    subtitle="Óbitos por meningite",
    date=("DTOBITO", "DT_OBITO", "DTNASC", "DT_NASC", "DTATESTADO"),
    sex=("SEXO", "CS_SEXO"),
    age=("IDADE", "IDADEANOS", "IDADE_ANOS"),
    age_unit=(),
    municipality=("CODMUNRES", "CODMUNOCOR", "MUNRES", "MUNOCOR", "ID_MN_RESI", "ID_MN_OCORR"),
    outcome=("LOCOCOR", "CIRCOBITO", "ASSISTMED"),
    diagnosis=("CAUSABAS", "CAUSABAS_O", "LINHAA", "LINHAB", "LINHAC", "LINHAD", "LINHAII",
               "ATESTADO", "CB_PRE"),
    codes=("CAUSABAS", "CAUSABAS_O", "LINHAA", "LINHAB", "LINHAC", "LINHAD", "LINHAII",
           "ATESTADO", "CB_PRE"),
)

CIHA = SourceProfile(
    name="CIHA",
    subtitle="Internações / atendimentos por meningite",
    date=("DT_ATEND", "DT_SAIDA", "DT_INTER", "DT_INTERNA", "DT_COMPET", "COMPET", "ANO_CMPT"),
    sex=("SEXO", "CS_SEXO"),
    age=("IDADE", "IDADE_ANOS", "IDADEANOS", "NU_IDADE_N"),
    age_unit=("COD_IDADE",),
    municipality=("MUNIC_RES", "MUNIC_MOV", "CODMUNRES", "CODMUN", "MUN_RES", "ID_MN_RESI"),
    outcome=("MODALIDADE", "COBRANCA", "MOTSAI", "MOT_SAIDA", "TIPO_ALTA", "DESFECHO"),
    diagnosis=("DIAG_PRINC", "DIAG_SECUN", "CIDPRI", "CID_PRINC", "CID", "DIAG", "PROC_REA",
               "PROC_PRINC"),
    codes=("DIAG_PRINC", "DIAG_SECUN", "CIDPRI", "CID_PRINC", "CID", "DIAG"),
)

PROFILES: Dict[str, SourceProfile] = {p.name: p for p in (SINAN, SIM, CIHA)}

# (campo, uso, leitura, observação) per source.
FIELD_GUIDE: Dict[str, List[Tuple[str, str, str, str]]] = {
    "SINAN": [
        ("DT_SIN_PRI", "data principal", "Início dos primeiros sintomas", "100% preenchido no dicionário"),
        ("DT_NOTIFIC", "data alternativa", "Data de notificação", "100% preenchido no dicionário"),
        ("NU_IDADE_N", "idade", "Idade codificada DATASUS", "converter para anos"),
        ("CS_SEXO", "sexo", "Sexo do paciente", "M/F/I"),
        ("ID_MN_RESI", "território", "Município de residência", "código IBGE"),
        ("ID_AGRAVO", "CID/agravo", "Código do agravo", "G039 constante no recorte"),
        ("CLASSI_FIN", "classificação", "Classificação final", "variável-chave de encerramento"),
        ("CON_DIAGES", "classificação", "Conclusão diagnóstica específica", "detalha conclusão quando preenchido"),
        ("EVOLUCAO", "desfecho", "Evolução clínica", "alta utilidade epidemiológica"),
    ],
    "SIM": [
        ("DTOBITO", "data principal", "Data do óbito", "100% preenchido no dicionário"),
        ("IDADE", "idade", "Idade codificada SIM", "converter para anos"),
        ("SEXO", "sexo", "Sexo da pessoa falecida", "1/2"),
        ("CODMUNRES", "território", "Município de residência", "código IBGE"),
        ("CODMUNOCOR", "território", "Município de ocorrência", "código IBGE"),
        ("CAUSABAS", "CID/agravo", "Causa básica do óbito", "campo CID-10 principal"),
        ("CAUSABAS_O", "CID/agravo", "Causa básica complementar/original", "útil para recorte e comparação"),
        ("LINHAA–LINHAII", "CID/agravo", "Causas nas linhas da DO", "captura menções associadas"),
        ("LOCOCOR", "categoria", "Local de ocorrência", "proxy categórico do evento"),
    ],
    "CIHA": [
        ("DT_ATEND", "data principal", "Data de atendimento", "AAAAMMDD; 100% preenchido"),
        ("DT_SAIDA", "data alternativa", "Data de saída", "AAAAMMDD; 100% preenchido"),
        ("IDADE + COD_IDADE", "idade", "Idade e unidade da idade", "usar conversão conjunta"),
        ("SEXO", "sexo", "Sexo", "1/3 no dicionário"),
        ("MUNIC_RES", "território", "Município de residência", "código IBGE"),
        ("MUNIC_MOV", "território", "Município do movimento/atendimento", "código IBGE"),
        ("DIAG_PRINC", "CID/agravo", "Diagnóstico principal", "campo CID-10 principal"),
        ("DIAG_SECUN", "CID/agravo", "Diagnóstico secundário", "baixa completude; usar como complementar"),
        ("MODALIDADE", "categoria", "Modalidade do registro", "categoria administrativa"),
    ],
}
