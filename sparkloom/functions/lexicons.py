"""Term tables. They must equal those of the flows being reproduced, for equal results."""

CORE = {
    "quantum_computing": ["quantum computing", "quantum computation", "quantum computer", "computacion cuantica", "computacao quantica", "computadora cuantica", "computador quantico"],
    "quantum_information": ["quantum information", "informacion cuantica", "informacao quantica", "quantum information science", "qubit", "qubits", "cubit", "q-bit"],
    "quantum_algorithms": ["quantum algorithm", "quantum algorithms", "algoritmo cuantico", "algoritmos cuanticos", "algoritmo quantico", "algoritmos quanticos", "grover algorithm", "shor algorithm", "quantum fourier transform", "quantum walk", "variational quantum eigensolver", "qaoa"],
    "quantum_cryptography": ["quantum cryptography", "criptografia cuantica", "criptografia quantica", "quantum key distribution", "quantum-safe", "post-quantum cryptography", "criptografia post-cuantica", "bb84"],
    "quantum_communication": ["quantum communication", "comunicacion cuantica", "comunicacao quantica", "quantum network", "quantum internet", "quantum teleportation", "teleportacion cuantica", "teletransporte cuantico"],
    "quantum_sensing": ["quantum sensing", "quantum metrology", "quantum sensor", "sensores cuanticos", "sensores quanticos", "sensado cuantico", "metrologia cuantica"],
    "quantum_technologies": ["quantum technologies", "quantum technology", "tecnologias cuanticas", "tecnologia cuantica", "tecnologias quanticas", "segunda revolucion cuantica", "second quantum revolution"],
    "quantum_engineering": ["quantum engineering", "ingenieria cuantica", "engenharia quantica"],
    "quantum_software": ["quantum software", "quantum programming", "programacion cuantica", "programacao quantica", "qiskit", "cirq", "pennylane", "ocean sdk"],
    "quantum_hardware": ["quantum hardware", "superconducting qubit", "trapped ion", "spin qubit", "topological qubit", "quantum circuit", "quantum gate", "quantum processor", "circuito cuantico", "circuito quantico", "puerta cuantica", "porta quantica", "nisq"],
    "quantum_machine_learning": ["quantum machine learning", "quantum neural network", "aprendizaje cuantico", "aprendizado quantico", "qml"],
    "quantum_error_correction": ["quantum error correction", "correccion de errores cuanticos", "correcao de erros quanticos", "fault tolerant quantum", "surface code", "stabilizer code", "codigos estabilizadores"],
}
ADJACENT = {
    "quantum_mechanics": ["quantum mechanics", "mecanica cuantica", "mecanica quantica"],
    "quantum_physics": ["quantum physics", "fisica cuantica", "fisica quantica"],
    "quantum_optics": ["quantum optics", "optica cuantica", "optica quantica"],
    "quantum_chemistry": ["quantum chemistry", "quimica cuantica", "quimica quantica"],
    "quantum_field_theory": ["quantum field theory", "teoria cuantica de campos", "teoria quantica de campos"],
    "condensed_matter": ["condensed matter", "materia condensada"],
    "solid_state": ["solid state", "solid-state physics", "estado solido", "fisica del estado solido", "fisica do estado solido"],
    "semiconductors": ["semiconductor", "semiconductors", "semiconductores", "semicondutores"],
    "photonics": ["photonics", "photonic", "fotonica"],
    "atomic_molecular": ["atomic physics", "molecular physics", "fisica atomica", "fisica molecular", "fisica atomica y molecular"],
    "modern_physics": ["modern physics", "fisica moderna", "fisica contemporanea"],
    "statistical_physics": ["statistical mechanics", "mecanica estadistica", "mecanica estatistica"],
}
GENERIC = {"quantum_general": ["cuantica", "cuantico", "quantum", "quantica", "quantico"]}
#: (phrase, category, tier) in taxonomy order.
TAXONOMY = [(p, c, t) for t, group in (("core", CORE), ("adjacent", ADJACENT), ("generic", GENERIC)) for c, ps in group.items() for p in ps]

STRONG = [
    "silabo", "syllabus", "malla curricular", "plan de estudios", "plan de estudio", "grade curricular", "matriz curricular", "plano de ensino", "projeto pedagogico",
    "ementa", "creditos", "credito", "prerrequisito", "prerequisito", "prerequisite", "pre-requisito", "pre requisito", "codigo del curso", "codigo de la asignatura",
    "carga horaria", "horas teoricas", "horas practicas", "unidades de credito", "pensum", "cuadro de asignaturas",
]
WEAK = [
    "curso", "cursos", "asignatura", "asignaturas", "materia", "materias", "catedra", "disciplina", "disciplinas", "curriculo", "curriculum", "catalogo", "catalogue",
    "catalog", "programa", "pregrado", "posgrado", "postgrado", "licenciatura", "maestria", "doctorado", "electivo", "electiva", "optativa", "obligatorio",
    "obligatoria", "obrigatoria", "graduacao", "pos-graduacao", "mestrado", "doutorado", "course", "courses", "undergraduate", "graduate", "master", "doctoral", "elective",
    "required", "credits", "semestre", "semester", "trimestre", "objetivos", "bibliografia", "contenido", "temario", "competencias", "modulo", "unidad",
    "departamento", "facultad", "escuela", "faculty", "department",
]
NONCOURSE = [
    "seminario", "seminar", "webinar", "workshop", "taller", "conferencia", "conference", "congreso", "simposio", "symposium", "coloquio", "colloquium",
    "noticia", "noticias", "news", "blog", "boletin", "newsletter", "evento", "eventos", "event", "agenda", "convocatoria", "tesis", "thesis", "dissertacao",
    "disertacion", "grupo de investigacion", "research group", "linea de investigacion", "laboratorio de investigacion", "research laboratory", "divulgacion", "outreach",
    "escuela de verano", "summer school", "winter school", "charla", "talk", "comunicado", "press release", "prensa", "premio", "award", "publicacion",
    "paper", "articulo", "preprint", "revista", "journal", "proceedings", "se investiga", "investigamos", "temas de investigacion", "areas de investigacion", "linhas de pesquisa", "pesquisamos",
]
ACADEMIC = [
    "cursos", "asignaturas", "materias", "plan de estudios", "malla curricular", "curriculo", "catalogo", "silabo", "syllabus", "pregrado", "posgrado",
    "licenciatura", "maestria", "doctorado", "facultad", "escuela", "departamento", "carrera", "programa", "oferta academica", "pensum",
    "disciplinas", "ementa", "grade curricular", "matriz curricular", "plano de ensino", "graduacao", "pos-graduacao", "mestrado", "doutorado", "faculdade", "escola", "carreira",
    "courses", "course catalog", "catalogue", "curriculum", "degree plan", "undergraduate", "graduate", "master", "doctoral", "faculty", "school", "department", "program", "academics",
]
STEM = [
    "fisica", "physics", "computacion", "computacao", "computing", "informatica", "computer science", "ingenieria", "engenharia", "engineering", "electronica", "eletronica", "electronics",
    "electrica", "eletrica", "electrical", "telecomunicaciones", "telecomunicacoes", "telecommunications", "matematica", "mathematics", "fotonica", "photonics", "ciencias", "sciences",
    "nanotecnologia", "nanotechnology",
]
UNDERGRAD = ["pregrado", "licenciatura", "bachillerato", "carrera profesional", "undergraduate", "bachelor", "graduacao", "bacharelado", "estudios generales"]
POSTGRAD = ["posgrado", "postgrado", "escuela de posgrado", "maestria", "magister", "doctorado", "graduate school", "master of science", "masters", "msc", "doctoral", "phd", "pos-graduacao", "mestrado", "doutorado"]
LOW_PRIORITY = [
    "noticia", "noticias", "news", "blog", "boletin", "evento", "eventos", "events", "agenda", "calendario", "prensa", "press", "comunicado", "sala de prensa", "admision", "admisiones",
    "admission", "admissions", "vestibular", "alumni", "egresados", "exalumnos", "deporte", "deportes", "sports", "atletismo", "transparencia", "administrativo", "administrativa", "licitaciones",
    "donaciones", "donations", "tienda", "store",
]
LANGUAGE_MARKERS = {
    "es": ["curso", "asignatura", "creditos", "prerrequisito", "semestre", "computacion", "fisica", "informacion", "cuantico", "plan de estudios"],
    "pt": ["curso", "disciplina", "creditos", "pre-requisito", "semestre", "computacao", "fisica", "informacao", "quantico", "ementa", "graduacao"],
    "en": ["course", "credits", "prerequisite", "semester"],
    "technical": ["quantum", "computing", "physics", "information"],
    "pt_only": ["disciplina", "computacao", "informacao", "quantico", "ementa", "graduacao"],
    "es_only": ["asignatura", "computacion", "informacion", "cuantico", "plan de estudios", "malla curricular"],
}
SOURCE_TYPES = [
    ("syllabus", ["silabo", "syllabus", "plano de ensino", "ementa", "programa del curso", "programa de la asignatura"]),
    ("curriculum_grid", ["malla curricular", "matriz curricular", "grade curricular", "pensum", "plan de estudios"]),
    ("catalog", ["catalogo", "catalog", "oferta academica", "cursos de posgrado", "cursos de pregrado", "lista de cursos", "relacion de asignaturas"]),
    ("department_page", ["/departamento", "department", "departamento de", "instituto de fisica", "facultad de", "faculty of"]),
    ("course_list", ["curso", "asignatura", "disciplina", "course", "materia"]),
]
COUNTRIES = {
    "argentina": "AR", "bolivia": "BO", "brazil": "BR", "brasil": "BR", "chile": "CL", "colombia": "CO", "costa rica": "CR", "cuba": "CU", "dominican republic": "DO",
    "republica dominicana": "DO", "ecuador": "EC", "el salvador": "SV", "guatemala": "GT", "honduras": "HN", "mexico": "MX", "nicaragua": "NI", "panama": "PA", "paraguay": "PY",
    "peru": "PE", "puerto rico": "PR", "uruguay": "UY", "venezuela": "VE", "bolivia plurinational state of": "BO", "venezuela bolivarian republic of": "VE",
}
CURRICULUM_URL = r"plan.?de.?estudio|malla|pensum|curricul|grade.?curricular|matriz.?curricular|plano.?de.?ensino|silabo|sílabo|syllabus|(?<![a-z])ementa|oferta.?academ|catalogo|catalog"
COURSE_URL = r"curso|course|syllabus|silabo|sílabo|asignatura|disciplina|programa|materia|pensum|ementa|catalogo|catalog|oferta.?academ|curricul|malla|grade.?curricular|matriz.?curricular|plano.?de.?ensino|posgrado|postgrado|graduate|undergraduate|graduacao|licenciatura|maestr[íi]a|mestrado|doutorado|doctorado|especializaci[oó]n|carrera|f[íi]sica|ingenier[íi]a|ciencias|computac|pregrado|plan.?de.?estudio"
COURSE_ANCHOR = r"malla|plan de estudio|pensum|s[íi]labo|syllabus|programa|curr[íi]cul|grade curricular|matriz curricular|ementa|asignatura|disciplina|curso"
LOW_URL = r"/(noticias?|news|blog|boletin|eventos?|events?|agenda|calendario|prensa|press|comunicado|galeria|gallery|admision(es)?|admissions?|vestibular|alumni|egresados|exalumnos|deportes?|sports|profesor|docentes?|staff|equipo|team|investigador|researcher|transparencia|licitacion|administrativ)"
HARD_SKIP_URL = (
    r"\.(jpg|jpeg|png|gif|svg|ico|mp4|mp3|zip|rar|exe|js|css|woff|woff2|ttf|eot)(\?.*)?$"
    r"|/(login|logout|wp-admin|wp-login|search|tag|autor|author|comment|registro|register|password|reset|shop|contact|contacto|sitemap|privacidad|privacy|terminos|terms|rss|atom|newsletter|suscri)"
    r"|/admin(?![a-z])|/cart(?![a-z])"
)
LEVEL_ALIASES = {"undergrad": "undergraduate", "bachelor": "undergraduate", "pregrado": "undergraduate", "masters": "graduate", "master": "graduate", "phd": "graduate", "doctorate": "graduate", "posgrado": "graduate", "postgrado": "graduate", "": "unknown"}
CLASS_ORDER = ["qise_core", "quantum_foundations_or_adjacent", "unclear", "non_course_or_contextual"]
#: Country attributes without a source of their own, of 2024: (code, THE rank, SCImago rank in physics, network member, national initiative, regional alliance member).
COUNTRY_FACTS = [
    ("AR", 601, 32, True, False, True), ("BR", 501, 13, True, False, True), ("CL", 601, 39, False, False, True), ("CO", 801, 47, False, False, True), ("MX", 601, 26, True, False, True),
    ("PE", 1001, 62, False, False, False), ("VE", 1001, 71, False, False, False), ("UY", 1001, 58, False, False, False), ("CR", 1001, 78, False, False, False), ("EC", 1001, 85, False, False, False),
    ("CU", 1001, 90, False, False, False),
]
INDICATORS = {"gdp_per_capita_usd": "NY.GDP.PCAP.CD", "rd_expenditure_pct_gdp": "GB.XPD.RSDV.GD.ZS", "internet_penetration_pct": "IT.NET.USER.ZS", "researchers_per_million": "SP.POP.SCIE.RD.P6"}
