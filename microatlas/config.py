"""Fixed values of the examination microdata.

Everything below is a fixed value: codes, names and settings that decide the
numbers in the reports. No logic lives here.
"""

# --- editions and courses ----------------------------------------------------
EDITIONS = (2014, 2017, 2021)
PROJECTED_EDITIONS = (2024, 2027)

COURSE_NAMES = {
    72: "Tecnologia em Análise e Desenvolvimento de Sistemas",
    79: "Tecnologia em Redes de Computadores",
    4003: "Engenharia da Computação",
    4004: "Ciência da Computação (Bacharelado)",
    4005: "Ciência da Computação (Licenciatura)",
    4006: "Sistemas de Informação",
    5809: "Engenharia de Computação",
    6409: "Tecnologia em Gestão da Tecnologia da Informação",
}
COURSE_TEACHING_TYPE = {
    72: "Tecnologia",
    79: "Tecnologia",
    4003: "Bacharelado",
    4004: "Bacharelado",
    4005: "Licenciatura",
    4006: "Bacharelado",
    5809: "Bacharelado",
    6409: "Tecnologia",
}
# Short course names of the evolution report.
COURSE_SHORT_EVOLUTION = {
    "Ciência da Computação (Bacharelado)": "CC Bacharelado",
    "Ciência da Computação (Licenciatura)": "CC Licenciatura",
    "Engenharia da Computação": "Eng. da Comp.",
    "Engenharia de Computação": "Eng. de Comp.",
    "Sistemas de Informação": "Sist. Informação",
    "Tecnologia em Análise e Desenvolvimento de Sistemas": "Tec. ADS",
    "Tecnologia em Gestão da Tecnologia da Informação": "Tec. GTI",
    "Tecnologia em Redes de Computadores": "Tec. Redes",
}
# Short course names of the two-way and trend reports.
COURSE_SHORT = {
    **COURSE_SHORT_EVOLUTION,
    "Ciência da Computação (Bacharelado)": "CC Bach.",
    "Ciência da Computação (Licenciatura)": "CC Lic.",
}

# --- places ------------------------------------------------------------------
STATE_INITIALS = {
    11: "RO", 12: "AC", 13: "AM", 14: "RR", 15: "PA", 16: "AP", 17: "TO",
    21: "MA", 22: "PI", 23: "CE", 24: "RN", 25: "PB", 26: "PE", 27: "AL",
    28: "SE", 29: "BA",
    31: "MG", 32: "ES", 33: "RJ", 35: "SP",
    41: "PR", 42: "SC", 43: "RS",
    50: "MS", 51: "MT", 52: "GO", 53: "DF",
}
STATE_NAMES = {
    11: "Rondônia", 12: "Acre", 13: "Amazonas", 14: "Roraima", 15: "Pará",
    16: "Amapá", 17: "Tocantins",
    21: "Maranhão", 22: "Piauí", 23: "Ceará", 24: "Rio Grande do Norte",
    25: "Paraíba", 26: "Pernambuco", 27: "Alagoas", 28: "Sergipe", 29: "Bahia",
    31: "Minas Gerais", 32: "Espírito Santo", 33: "Rio de Janeiro",
    35: "São Paulo",
    41: "Paraná", 42: "Santa Catarina", 43: "Rio Grande do Sul",
    50: "Mato Grosso do Sul", 51: "Mato Grosso", 52: "Goiás",
    53: "Distrito Federal",
}
REGION_NAMES = {1: "Norte", 2: "Nordeste", 3: "Centro-Oeste", 4: "Sudeste", 5: "Sul"}
REGION_OF_STATE = {
    "AC": "Norte", "AM": "Norte", "AP": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte",
    "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste",
    "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MS": "Centro-Oeste", "MT": "Centro-Oeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste",
    "PR": "Sul", "RS": "Sul", "SC": "Sul",
}
UNKNOWN_REGION = "Desconhecido"

# --- institutions ------------------------------------------------------------
CATEGORY_NAMES = {
    1: "Pública Federal",
    2: "Pública Estadual",
    3: "Pública Municipal",
    4: "Privada com fins lucrativos",
    5: "Privada sem fins lucrativos",
    7: "Especial",
}
MODALITY_NAMES = {1: "Presencial", 2: "EAD"}
UNKNOWN_MODALITY = "Não informado"
PUBLIC_PATTERN = "%blica%"
# The two-way tables also take these words for a public institution.
PUBLIC_WORDS = ("Federal", "Estadual", "Municipal")

# --- questionnaire -----------------------------------------------------------
INCOME_NAMES = {
    "A": "Até 1,5 SM",
    "B": "1,5 a 3 SM",
    "C": "3 a 4,5 SM",
    "D": "4,5 a 6 SM",
    "E": "6 a 10 SM",
    "F": "10 a 30 SM",
    "G": "Mais de 30 SM",
}
SCHOOL_NAMES = {
    "A": "Todo em escola pública",
    "B": "Maior parte em escola pública",
    "C": "Metade em escola pública",
    "D": "Maior parte em escola privada",
    "E": "Todo em escola privada",
}
# Labels of encoded (0-based) answers, one map per report that words them.
INCOME_SHORT_BANDS = {
    "0": "Não decl.", "1": "Até 1,5SM", "2": "1,5–3SM",
    "3": "3–4,5SM", "4": "4,5–6SM", "5": "6–10SM",
}
INCOME_SHORT = {**INCOME_SHORT_BANDS, "1": "≤1,5SM"}
RACE_NAMES = {
    "0": "Não decl.", "1": "Branca", "2": "Preta",
    "3": "Parda", "4": "Amarela", "5": "Indígena",
}
FUNDING_NAMES = {
    "0": "Sem financiamento", "1": "ProUni", "2": "FIES",
    "3": "ProUni + FIES", "4": "Outro público", "5": "Outro privado",
}
FUNDING_SHORT = {**FUNDING_NAMES, "0": "Sem bolsa", "3": "ProUni+FIES"}
MARITAL_NAMES = {
    "A": "Solteiro(a)",
    "B": "Casado(a)",
    "C": "Separado(a)/Divorciado(a)",
    "D": "Viúvo(a)",
}
INTERNET_NAMES = {
    "A": "Não tem acesso",
    "B": "Raramente",
    "C": "Às vezes",
    "D": "Frequentemente",
    "E": "Sempre",
}
_WORK_HOURS = {
    "0": "Não trabalha",
    "1": "Até 20 h/sem",
    "2": "Entre 20 e 40 h/sem",
    "3": "Mais de 40 h/sem",
}
HABIT_NAMES = {
    "qe_horas_estudo": {
        "0": "Nenhuma hora",
        "1": "De 1 a 3 h/sem",
        "2": "De 4 a 7 h/sem",
        "3": "Mais de 7 h/sem",
    },
    "qe_trabalha": _WORK_HOURS,
    "qe_horas_trabalho": _WORK_HOURS,
    "qe_uso_biblioteca": {"A": "Nunca/quase nunca", "B": "Sempre/quase sempre"},
    "qe_acesso_internet": {
        "A": "Nunca",
        "B": "Raramente",
        "C": "Ocasionalmente",
        "D": "Frequentemente",
        "E": "Sempre",
    },
}
HABIT_TITLES = {
    "qe_horas_estudo": "Horas de estudo extraclasse (QE_I17)",
    "qe_trabalha": "Vínculo empregatício (QE_I18)",
    "qe_horas_trabalho": "Horas de trabalho semanal (QE_I19)",
    "qe_uso_biblioteca": "Frequência de uso da biblioteca (QE_I21)",
    "qe_acesso_internet": "Acesso à internet para estudo (QE_I23)",
}
INTENSITY_NAMES = (
    "Nenhuma / Não trabalha",
    "Baixa intensidade",
    "Média intensidade",
    "Alta intensidade",
)
BINARY_NAMES = {"F": "Feminino", "M": "Masculino"}

# --- raw layer ---------------------------------------------------------------
GROUP_COLUMN = "CO_GRUPO"
COURSE_COLUMN = "CO_CURSO"
YEAR_COLUMN = "NU_ANO"
RAW_COLUMNS = (
    "NU_ANO", "CO_GRUPO", "CO_CURSO", "CO_REGIAO_CURSO", "CO_CATEGAD",
    "CO_ORGACAD", "CO_MODALIDADE", "CO_UF_CURSO", "CO_MUNIC_CURSO", "CO_IES",
    "NO_IES",
    "TP_PRES", "TP_PR_GER", "NT_GER", "NT_FG", "NT_CE",
    "QE_I01", "QE_I02", "QE_I04", "QE_I05", "QE_I08",
    "QE_I17", "QE_I18", "QE_I19", "QE_I21", "QE_I23",
    "QI_1", "QI_2", "QI_4", "QI_5", "QI_7",
)
OPTIONAL_COLUMNS = (
    "QI_1", "QI_2", "QI_4", "QI_5", "QI_7",
    "CO_MODALIDADE", "CO_UF_CURSO", "CO_MUNIC_CURSO", "CO_IES", "NO_IES",
)
# Whole-value tokens that mean "missing": the cleaner's own four, then those
# the text reader of the source format drops.
NA_TOKENS = (
    ".", "", " ", "NA",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NULL", "NaN", "None", "n/a", "nan",
    "null",
)
SCORE_COLUMNS = ("NT_GER", "NT_FG", "NT_CE")
CODE_COLUMNS = (
    "NU_ANO", "CO_GRUPO", "CO_REGIAO_CURSO", "CO_CATEGAD", "CO_ORGACAD",
    "CO_MODALIDADE", "CO_UF_CURSO", "CO_MUNIC_CURSO",
)
PRESENCE_COLUMN = "TP_PRES"
PRESENT = "555"
CONTROL_COLUMNS = ("TP_PRES", "TP_PR_GER")

# --- fact table: source column -> serving column -------------------------------
FACT_COLUMNS = {
    "NU_ANO": "nu_ano",
    "CO_GRUPO": "co_grupo",
    "CURSO_LABEL": "curso_nome",
    "CO_REGIAO_CURSO": "co_regiao",
    "REGIAO_LABEL": "regiao_nome",
    "CO_CATEGAD": "co_categad",
    "CATEGAD_LABEL": "tipo_ies",
    "CO_ORGACAD": "co_orgacad",
    "CO_MODALIDADE": "co_modalidade",
    "MODALIDADE_LABEL": "modalidade",
    "CO_UF_CURSO": "co_uf",
    "UF_SIGLA": "uf_sigla",
    "UF_NOME": "uf_nome",
    "CO_MUNIC_CURSO": "co_municipio",
    "CO_IES": "co_ies",
    "NO_IES": "no_ies",
    "TIPO_ENSINO": "tipo_ensino",
    "NT_GER": "nt_ger",
    "NT_FG": "nt_fg",
    "NT_CE": "nt_ce",
    "NT_GER_NORM": "nt_ger_norm",
    "FAIXA_NOTA": "faixa_nota",
    "FAIXA_PREVISTA": "faixa_prevista",
    "QE_I01": "qe_estado_civil",
    "QE_I02": "qe_escola_em",
    "ESCOLA_EM_LABEL": "escola_em_nome",
    "QE_I04": "qe_raca_cor",
    "QE_I05": "qe_renda",
    "RENDA_LABEL": "renda_nome",
    "QE_I08": "qe_financiamento",
    "QE_I17": "qe_horas_estudo",
    "QE_I18": "qe_trabalha",
    "QE_I19": "qe_horas_trabalho",
    "QE_I21": "qe_uso_biblioteca",
    "QE_I23": "qe_acesso_internet",
    "QI_1": "qi_laboratorios",
    "QI_2": "qi_biblioteca",
    "QI_4": "qi_docentes",
    "QI_5": "qi_projeto_ped",
    "QI_7": "qi_extracurr",
    "CLUSTER_ID": "cluster_id",
    "PCA_X": "pca_x",
    "PCA_Y": "pca_y",
}

# --- scores ------------------------------------------------------------------
CLASSES = ("baixo", "medio", "alto")
BAND_QUANTILES = (0.33, 0.66)
BUCKETS = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90)
BUCKET_WIDTH = 10
RELATIVE_CEILING = 90.0
POINT_RADIUS = (4.0, 30.0, 0.8)  # smallest, largest, factor on sqrt(n)
MIN_R2 = 0.75
PLAUSIBLE_SCORES = (20.0, 100.0)
MIN_TREND_POINTS = 3

# --- models ------------------------------------------------------------------
SEED = 42
CLUSTERS = 4
KMEANS_RESTARTS = 10
KMEANS_ITERATIONS = 300
TEST_FRACTION = 0.2
TREES = 100
FEATURES = (
    "CO_REGIAO_CURSO", "CO_CATEGAD", "QE_I02", "QE_I04", "QE_I05",
    "QE_I08", "QE_I17", "QE_I18", "QE_I19",
)
FEATURE_NAMES = {
    "QE_I05": "Renda familiar",
    "QE_I19": "Horas de trabalho",
    "QE_I18": "Trabalha atualmente",
    "QE_I08": "Financiamento estudantil",
    "QE_I02": "Tipo de escola no EM",
    "QE_I04": "Raça/Cor",
    "QE_I17": "Horas de estudo",
    "CO_CATEGAD": "Categoria IES",
    "CO_REGIAO_CURSO": "Região",
}

# --- report filters: parameter -> (fact column, type) --------------------------
FILTER_COLUMNS = {
    "ano": ("nu_ano", "bigint"),
    "curso": ("co_grupo", "bigint"),
    "tipo": ("tipo_ensino", "string"),
    "regiao": ("co_regiao", "int"),
    "uf": ("co_uf", "bigint"),
    "municipio": ("co_municipio", "bigint"),
}
