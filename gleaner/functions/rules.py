"""Ordered rule lists. Order is part of the meaning where a list says so."""

# Section headings, by section in order; compared with folded lines.
HEADINGS = {
    "funciones": ("funciones", "funciones principales", "funciones del puesto", "principales funciones", "responsabilidades", "responsabilidades del puesto", "actividades", "actividades a realizar", "principales actividades", "que haras", "que haras en el puesto", "tus retos", "misión del puesto", "mision del puesto", "descripcion del puesto", "acerca del puesto", "tareas", "labores a realizar", "objetivo del puesto"),
    "requisitos": ("requisitos", "requisitos del puesto", "requisitos minimos", "requerimientos", "perfil", "perfil del puesto", "perfil requerido", "que buscamos", "buscamos", "a quien buscamos", "competencias", "conocimientos", "conocimientos requeridos", "experiencia requerida", "formacion academica", "estudios", "requisitos indispensables"),
    "beneficios": ("beneficios", "beneficios del puesto", "que ofrecemos", "ofrecemos", "te ofrecemos", "que te ofrecemos", "condiciones", "condiciones laborales", "nuestros beneficios", "beneficios corporativos", "por que trabajar con nosotros", "que ganas", "compensacion", "horario y beneficios"),
}

# Headings that end a posting; checked before the sections.
CLOSING = ("documentos", "documentacion", "cronograma", "etapas del proceso", "proceso de seleccion", "como postular", "postular", "postula ahora", "para postular", "preguntas frecuentes", "otras convocatorias", "ver mas convocatorias", "avisos relacionados", "empleos similares", "ofertas similares", "comparte", "siguenos", "suscribete", "sobre nosotros", "contacto", "terminos y condiciones", "politica de privacidad", "aviso legal")

# Verbs that open a duty.
DUTY_VERBS = ("gestionar", "elaborar", "realizar", "coordinar", "supervisar", "desarrollar", "atender", "registrar", "analizar", "controlar", "ejecutar", "apoyar", "diseñar", "implementar", "reportar", "asegurar", "planificar", "negociar", "capacitar", "monitorear", "administrar", "preparar", "validar", "liderar")

# Filler phrases.
FILLER = ("excelente ambiente laboral", "buen clima laboral", "grato ambiente", "oportunidad de crecimiento", "linea de carrera", "somos una empresa lider", "unete a nuestro equipo", "postula ya", "empresa en crecimiento", "estabilidad laboral")

# Regions, in order.
REGIONS = ("Lima", "Arequipa", "La Libertad", "Piura", "Lambayeque", "Cusco", "Junín", "Áncash", "Ica", "Cajamarca", "Puno", "Loreto", "Callao", "Tacna", "San Martín", "Ayacucho", "Huánuco", "Ucayali", "Moquegua", "Apurímac", "Amazonas", "Tumbes", "Pasco", "Madre de Dios", "Huancavelica")

# Cities and their regions, in order.
CITIES = {"lima": "Lima", "callao": "Callao", "arequipa": "Arequipa", "trujillo": "La Libertad", "chiclayo": "Lambayeque", "piura": "Piura", "cusco": "Cusco", "cuzco": "Cusco", "huancayo": "Junín", "chimbote": "Áncash", "huaraz": "Áncash", "ica": "Ica", "chincha": "Ica", "pisco": "Ica", "tacna": "Tacna", "puno": "Puno", "juliaca": "Puno", "iquitos": "Loreto", "pucallpa": "Ucayali", "tarapoto": "San Martín", "cajamarca": "Cajamarca", "ayacucho": "Ayacucho", "huanuco": "Huánuco", "tumbes": "Tumbes", "moquegua": "Moquegua", "ilo": "Moquegua", "sullana": "Piura", "talara": "Piura", "abancay": "Apurímac", "cerro de pasco": "Pasco"}

# Districts of the capital.
DISTRICTS = ("san isidro", "miraflores", "surco", "santiago de surco", "la molina", "san borja", "jesus maria", "magdalena", "lince", "barranco", "chorrillos", "surquillo", "san miguel", "pueblo libre", "los olivos", "san martin de porres", "comas", "independencia", "ate", "santa anita", "san juan de lurigancho", "villa el salvador", "cercado de lima", "la victoria", "breña", "rimac", "callao", "bellavista", "la perla", "ventanilla")

# Cues of each category, in order; matched at the start of a word.
CATEGORY_CUES = {
    "Tecnología": ("desarrollador", "developer", "programador", "backend", "frontend", "fullstack", "qa", "devops", "data", "datos", "software", "sistemas", "ti ", "it ", "ciberseguridad", "soporte tecnico", "analista funcional", "ux", "ui", "scrum", "cloud", "base de datos", "sre"),
    "Ventas": ("vendedor", "venta", "comercial", "seguros", "ejecutivo comercial", "asesor de ventas", "key account", "kam", "televentas", "promotor", "impulsador"),
    "Contabilidad": ("contable", "contador", "contabilidad", "tesoreria", "tributario", "costos", "auditoria", "facturacion", "cobranza", "finanzas"),
    "Salud": ("enfermer", "medico", "tecnico en enfermeria", "odontolog", "psicolog", "nutricionista", "obstetra", "farmac", "laboratorio clinico", "tecnologo medico", "fisioterapeuta"),
    "Prácticas": ("practicante", "practicas", "trainee", "pasante", "intern"),
    "Administración": ("asistente administrativ", "administrativ", "recepcionist", "secretari", "asistente de gerencia", "coordinador administrativo"),
    "Logística": ("almacen", "logistic", "despacho", "distribucion", "transporte", "conductor", "chofer", "operario de almacen", "picking", "supply", "compras", "abastecimiento"),
    "Marketing": ("marketing", "community manager", "publicidad", "comunicaciones", "diseñador grafico", "contenido", "redes sociales", "trade marketing", "brand", "seo", "performance"),
    "Ingeniería": ("ingenier", "mantenimiento", "produccion", "planta", "mecanic", "electric", "civil", "industrial", "seguridad y salud", "sst", "calidad", "proyectos"),
    "Educación": ("docente", "profesor", "tutor", "auxiliar de educacion", "coordinador academico", "capacitador", "instructor"),
    "Legal": ("abogad", "legal", "juridic", "asesor legal", "compliance"),
    "Recursos Humanos": ("recursos humanos", "rrhh", "reclutador", "reclutamiento", "seleccion de personal", "gestion humana", "talento", "planilla"),
    "Atención al Cliente": ("call center", "atencion al cliente", "servicio al cliente", "customer service", "asesor telefonico", "back office", "plataforma de atencion"),
    "Construcción": ("obra", "construccion", "albañil", "maestro de obra", "topografo", "capataz", "encofrador"),
    "Gastronomía": ("cocinero", "chef", "mozo", "barista", "bartender", "panadero", "pastelero", "ayudante de cocina", "azafata"),
}

# What a piece of a title that names a job doesn't hold.
TITLE_NOISE = ("gana", "ganaras", "ganaras hasta", "sueldo", "salario", "remuneracion", "planilla", "beneficios", "bono", "bonos", "pago", "pagos", "ingreso inmediato", "ingreso a planilla", "alimentacion", "movilidad", "horas extra", "hora extra", "turnos", "turno", "horario", "rotativo", "rotativos", "part time", "full time", "urgente", "urgentemente", "postula", "postular", "unete", "sumate", "trabaja con", "importante empresa", "gran empresa", "empresa lider", "reconocida empresa", "contratacion inmediata", "inicio inmediato", "sin experiencia", "con experiencia", "vacantes", "vacante", "convocatoria", "oportunidad", "capacitacion", "crecimiento", "linea de carrera", "desde s/", "s/", "soles", "referidos", "lunes a viernes", "lunes a sabado", "de lunes")

# Words of a title kept in lower case, and acronyms kept in upper case.
SMALL_WORDS = ("de", "del", "la", "las", "el", "los", "y", "e", "o", "u", "en", "para", "por", "con", "a", "al", "sin", "sobre", "the", "of")
ACRONYMS = ("ti", "it", "rrhh", "sst", "sso", "ssoma", "hse", "qa", "ux", "ui", "sap", "erp", "crm", "bi", "seo", "sem", "kam", "b2b", "b2c", "cnc", "sac", "eirl", "srl", "cas", "gpt", "ia", "ai", "iso", "hvac", "pmo")

# Trades of one word, and titles of several words, in order.
TRADES = ("asesor", "asistente", "operario", "operaria", "operador", "operadora", "analista", "ingeniero", "ingeniera", "tecnico", "tecnica", "practicante", "supervisor", "supervisora", "coordinador", "coordinadora", "jefe", "jefa", "gerente", "auxiliar", "administrador", "administradora", "vendedor", "vendedora", "cajero", "cajera", "promotor", "promotora", "representante", "arquitecto", "arquitecta", "contador", "contadora", "abogado", "abogada", "enfermero", "enfermera", "docente", "profesor", "profesora", "chofer", "conductor", "conductora", "almacenero", "almacenera", "carpintero", "panadero", "panadera", "recepcionista", "secretaria", "desarrollador", "desarrolladora", "disenador", "disenadora", "especialista", "ejecutivo", "ejecutiva", "consultor", "consultora", "gestor", "gestora", "anfitrion", "anfitriona", "despachador", "despachadora", "ayudante", "mozo", "moza", "azafata", "cocinero", "cocinera", "pizzero", "pizzera", "barista", "mecanico", "mecanica", "electricista", "soldador", "gasfitero", "vigilante", "reponedor", "reponedora", "digitador", "digitadora", "teleoperador", "teleoperadora", "capacitador", "capacitadora", "cobrador")
COMPOUND_TITLES = ("atencion al cliente", "customer service", "back office", "front office", "call center", "community manager", "project manager", "product owner", "help desk", "soporte tecnico", "mesa de partes", "jefe de tienda", "personal de limpieza", "personal de seguridad", "agente de seguridad", "auxiliar de limpieza", "asesor de ventas", "fuerza de ventas")

# Legal minimum wage, sane monthly amounts by currency, and the reference rate.
MINIMUM_WAGE = 1130
MONTHLY_RANGE = {"PEN": (500, 80_000), "USD": (200, 25_000)}
REFERENCE_RATE = 3.75

# Wording that hides the pay, noise near amounts, labels of pay, and words for other money.
VAGUE_PAY = ("a convenir", "a tratar", "por convenir", "según experiencia", "segun experiencia", "acorde al mercado", "acorde a mercado", "de acuerdo al mercado", "sueldo competitivo", "salario competitivo", "remuneración competitiva", "remuneracion competitiva", "acorde a la experiencia", "sueldo atractivo", "salario atractivo", "según perfil", "segun perfil", "a coordinar en la entrevista", "se conversará en la entrevista", "no especificado", "confidencial")
PAY_NOISE = ("ley 29783", "ley 30036", "iso 9001", "iso 45001", "d.s.", "art.", "ruc", "dni", "whatsapp", "celular", "anexo", "código", "codigo")
PAY_LABELS = ("sueldo", "salario", "remuneracion", "remuneración", "basico", "básico", "base", "haber", "ingreso mensual", "pago mensual", "renta")
EXPLICIT_LABELS = ("sueldo", "salario", "remuneracion", "remuneración")
NOT_PAY = ("comision", "comisiones", "bono", "bonific", "incentivo", "premio", "movilidad", "alimentacion", "tarjeta de alimentos", "vale", "canasta", "asignacion familiar", "gratificacion", "cts", "utilidades", "aguinaldo", "descuento", "afiliacion", "seguro", "eps", "refrigerio", "viatico")

# Pay periods in order: markers, monthly factor, sane amounts.
PERIODS = {
    "anual": (r"anual(?:es)?|al\s+a[ñn]o|por\s+a[ñn]o", 1 / 12, (8_000, 900_000)),
    "quincenal": (r"quincenal(?:es)?|por\s+quincena|a\s+la\s+quincena", 2.0, (400, 10_000)),
    "semanal": (r"semanal(?:es)?|por\s+semana|a\s+la\s+semana", 4.33, (200, 3_000)),
    "diario": (r"diarios?|por\s+d[ií]a|al\s+d[ií]a|jornal", 26.0, (30, 700)),
    "por hora": (r"por\s+hora|la\s+hora|x\s+hora|/\s*hora", 208.0, (6, 150)),
    "mensual": (r"mensual(?:es)?|al\s+mes|por\s+mes", 1.0, (500, 80_000)),
}

# Minimums of each profile: duties, requirements, benefits, days without a deadline.
PROFILES = {"privado": (3, 3, 2, 45), "publico": (0, 3, 2, 21)}
THRESHOLD, MAX_AGE_DAYS = 70, 60

# Cues of concrete benefits and requirements, and phrases that hide an employer.
CONCRETE_BENEFITS = ("planilla", "eps", "essalud", "seguro", "sctr", "bono", "utilidades", "gratificacion", "cts", "afp", "movilidad", "alimentacion", "almuerzo", "comedor", "asignacion familiar", "vacaciones", "capacitacion", "descuento", "home office", "dia libre", "horario flexible", "convenio", "subvencion", "aguinaldo", "canasta", "linea de carrera", "vale")
CONCRETE_REQUIREMENTS = ("años", "anos", "año", "experiencia", "titulado", "bachiller", "egresado", "estudiante", "tecnico", "universitario", "licencia", "colegiatura", "certificacion", "excel", "ingles", "manejo de", "conocimiento en", "dominio de", "disponibilidad")
HIDDEN_EMPLOYER = ("confidencial", "importante empresa", "empresa lider", "reconocida empresa", "prestigiosa empresa")

# Words of a title that a fingerprint leaves out.
FINGERPRINT_STOPS = ("para", "de", "del", "la", "el", "los", "las", "en", "con", "urgente", "importante", "empresa", "gran", "oportunidad", "sr", "sra", "srta", "sac", "eirl", "srl", "y", "o")
