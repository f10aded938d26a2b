"""Fixed values of the audit contract.

Everything here is data that results depend on: names of states and labels, word lists,
patterns, thresholds and sentences. Logic lives elsewhere.
"""

# ---------------------------------------------------------------- fixed values: enums
STATES = ("RECEBIDA", "PROCESSANDO", "CONCLUIDA", "FALHOU")
TERMINAL_STATES = ("CONCLUIDA", "FALHOU")
TRANSITIONS = (
    ("RECEBIDA", "PROCESSANDO"),
    ("RECEBIDA", "FALHOU"),
    ("PROCESSANDO", "CONCLUIDA"),
    ("PROCESSANDO", "FALHOU"),
)
SEVERITIES = ("BAIXA", "MEDIA", "ALTA", "CRITICA")
LEVELS = ("A", "AA", "AAA")
ALT_MISSING, ALT_EMPTY, ALT_PRESENT = "AUSENTE", "VAZIO", "PRESENTE"
LABELS = ("GOOD", "WEAK", "INSUFFICIENT")
GOOD, WEAK, INSUFFICIENT = LABELS
PRINCIPLES = (
    ("1", "PERCEPTIVEL", "Perceptivel"),
    ("2", "OPERAVEL", "Operavel"),
    ("3", "COMPREENSIVEL", "Compreensivel"),
    ("4", "ROBUSTO", "Robusto"),
)
ICT_APPLICABILITY = ("DIRETA", "COM_SUBSTITUICAO", "INAPLICAVEL")
TRAIN, VALIDATION, TEST = "treino", "validacao", "teste"
SPLITS = (TRAIN, VALIDATION, TEST)
LABEL_ORIGINS = ("heuristica", "humano", "sintetico_fallback", "documentos_governamentais")
PROVENANCES = ("FIXTURE", "MODELO")
ROLES = ("USUARIO", "ASSISTENTE")

# ------------------------------------------------------------ fixed values: parameters
PENALTIES = {"CRITICA": 25, "ALTA": 15, "MEDIA": 8, "BAIXA": 3}
WEIGHTS = {"PERCEPTIVEL": 25, "OPERAVEL": 25, "COMPREENSIVEL": 25, "ROBUSTO": 25}
MAX_SCORE = 100
TRAIN_BELOW, VALIDATION_BELOW = 70, 85
NO_ALT_PREFIX = "__sem_alt__"
FORMAT_VERSION = 2
DATASET_MINIMUM = 600
REVIEW_PER_CLASS, REVIEW_MINIMUM, KAPPA_MINIMUM = 50, 150, 0.60
TRAIN_MINIMUM_PER_CLASS, TRAIN_MINIMUM = 3, 15
FOLDS, MINIMUM_FOLDS = 5, 2
MINORITY_SUPPORT = 5
RETRY_ATTEMPTS, RETRY_INITIAL_MS, RETRY_MULTIPLIER, RETRY_CAP_MS = 4, 500, 2.0, 10_000
OUTBOX_BATCH, OUTBOX_MAX_ATTEMPTS = 50, 10
RATE_CAP, RATE_WINDOW_SECONDS = 30, 3600
MONTHLY_BUDGET_CENTS = 1000
CONTEXT_TURNS = 10
CONTEXT_CHARS = 400
MAX_ENTRIES = 2000
MAX_PACKAGE_BYTES = 512 * 1024 * 1024
MAX_PART_BYTES = 32 * 1024 * 1024
MAX_PAGE_BYTES = 5 * 1024 * 1024
QUOTA = 50
CONSUMER = "analise-rule-engine"

# --------------------------------------------------------------- fixed values: catalogue
CRITERIA = (
    ("1.1.1", "Non-text Content", "A", "direta"),
    ("1.3.1", "Info and Relationships", "A", "direta"),
    ("2.4.2", "Page Titled", "A", "com_substituicao"),
    ("2.4.4", "Link Purpose (In Context)", "A", "direta"),
    ("3.1.1", "Language of Page", "A", "com_substituicao"),
)
RULES = (
    ("IMAGEM_SEM_TEXTO_ALTERNATIVO", "1.1.1", "ALTA"),
    ("TABELA_SEM_CABECALHO", "1.3.1", "ALTA"),
    ("ORDEM_HIERARQUICA_CABECALHOS", "1.3.1", "MEDIA"),
    ("TITULO_AUSENTE", "2.4.2", "MEDIA"),
    ("LINK_SEM_TEXTO_DESCRITIVO", "2.4.4", "MEDIA"),
    ("IDIOMA_NAO_DECLARADO", "3.1.1", "ALTA"),
)

# -------------------------------------------------------------- fixed values: word lists
GENERIC_LINK_TEXTS = (
    "clique aqui", "clique", "aqui", "link", "este link", "veja aqui", "saiba mais",
    "leia mais", "mais", "mais informacoes", "mais informacoes aqui", "acesse",
    "acesse aqui", "baixe aqui", "download", "ver", "veja", "click here", "here",
    "read more", "more", "learn more",
)
GENERIC_ALT_TEXTS = (
    "clique aqui", "click here", "saiba mais", "leia mais", "veja mais", "imagem", "image",
    "foto", "figura", "logo", "logotipo", "banner", "icone", "ícone", "picture",
    "sem titulo", "sem título", "untitled",
)
BLOCKED_TERMS = (
    "imagem", "image", "img", "foto", "photo", "figura", "figure", "fig", "logo",
    "logotipo", "banner", "icone", "icon", "picture", "pic", "clique aqui", "click here",
    "saiba mais", "leia mais", "veja mais", "screenshot", "captura de tela", "arquivo",
    "file", "documento", "de", "da", "do", "of", "the", "a", "o",
)
JUNK_LITERALS = (
    "ds_store", ".ds_store", "thumbs.db", "untitled", "sem titulo", "no description",
    "no description available", "n/a", "na", "none", "null", "nil", "unknown",
    "desconhecido", "sem descricao", "-", "--", "?", "...",
)
SOLO_TERMS = (
    "imagem", "imagens", "image", "images", "img", "foto", "fotos", "photo", "figura",
    "figure", "fig", "logo", "logotipo", "banner", "icone", "icon", "picture", "pic",
    "thumbnail", "thumb", "avatar", "ilustracao", "grafico", "capa", "arte", "midia",
    "alt", "placeholder", "spacer", "sem titulo", "untitled", "texto alternativo",
    "descricao da imagem", "alt text", "lorem ipsum", "insira a descricao",
)
CONFIG_PARTS = (
    "styles.xml", "settings.xml", "webSettings.xml", "fontTable.xml", "numbering.xml",
    "stylesWithEffects.xml",
)
COMMENT_PARTS_WITHOUT_TEXT = ("commentsExtended", "commentsIds", "commentsExtensible")

# ------------------------------------------- fixed values: synthetic alt texts by pattern
SYNTHETIC_ALTS = (
    ("nome_de_arquivo", (
        "IMG_0001.jpg", "IMG_4821.JPG", "DSC_0142.jpg", "DSCN2201.JPG", "P1010334.JPG",
        "image1.png", "image_02.png", "img-03.gif", "foto (3).jpeg", "foto1.jpg",
        "Captura de tela 2024-03-11 101122.png", "Screenshot 2023-11-02 at 09.14.55.png",
        "Sem titulo-1.psd", "Documento1.png", "Imagem colada.png", "unnamed.jpg",
        "download.png")),
    ("hash_ou_placeholder_de_layout", (
        "3f2a9c1e8b7d.jpg", "a1b2c3d4e5f6.png", "0c9f4e2b.webp", "b47e1f90ac33d2.jpeg",
        "f1e2d3c4b5a6978.png", "e3b0c44298fc.gif", "1x1.gif", "spacer.gif", "pixel.png",
        "blank.gif", "dot.png")),
    ("termo_generico", (
        "imagem", "foto", "figura", "image", "picture", "logo", "logotipo", "banner",
        "ícone", "thumbnail", "avatar", "midia", "arte", "capa")),
    ("placeholder", (
        "alt", "alt text", "texto alternativo", "descricao da imagem", "TODO", "xxx",
        "teste", "lorem ipsum", "n/a", "-", "...", "0", "123")),
)
SYNTHETIC_MAXIMUM = 50

# ------------------------------------------------ fixed values: recommendation sentences
RECOMMENDATIONS = {
    "IMAGEM_SEM_TEXTO_ALTERNATIVO":
        "Descreva a imagem no atributo de texto alternativo. Se ela for decorativa, deixe o "
        "alt vazio para que o leitor de tela a ignore.",
    "TABELA_SEM_CABECALHO":
        "Marque a primeira linha da tabela como linha de cabecalho, para que o leitor de tela "
        "anuncie a que coluna cada celula pertence.",
    "ORDEM_HIERARQUICA_CABECALHOS":
        "Nao pule niveis de titulo. Depois de um H1 vem H2; o salto quebra a navegacao por "
        "estrutura.",
    "TITULO_AUSENTE":
        "Preencha o titulo do documento nas propriedades do arquivo. E o primeiro dado que o "
        "leitor de tela anuncia.",
    "LINK_SEM_TEXTO_DESCRITIVO":
        "Troque o texto do link por algo que descreva o destino fora de contexto. 'Clique "
        "aqui' nao diz para onde leva.",
    "IDIOMA_NAO_DECLARADO":
        "Declare o idioma do documento, para que o leitor de tela escolha a pronuncia correta.",
}
DEFAULT_RECOMMENDATION = "Corrija o problema apontado seguindo o criterio WCAG citado ao lado."

# ----------------------------------------------------------------- fixed values: patterns
# \w of the contract is "letter, number or underscore" on Unicode text, spelled out here so
# that every engine reads it alike.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
NOISE_ONLY = r"^[^\p{L}\p{Nl}\p{No}]+$"
HAS_LETTER = r"[\p{L}\p{Nl}\p{No}]"
SERVED_FILE_NAME = (
    r"(?i)^[\p{L}\p{N}_\-. ]+\.(jpe?g|png|gif|bmp|svg|webp|emf|wmf|tiff?)$")
ARCHIVE_FILE_NAME = (
    r"(?i)^[\p{L}\p{N}_\-. ()]*\.(jpe?g|png|gif|bmp|svg|webp|tiff?|pdf|ogv|webm)$")
ORPHAN_EXTENSION = r"^\.[\p{L}\p{N}_]{2,5}$"
WEB_EXTENSION = r"(jpe?g|png|gif|bmp|svg|webp|tiff?|ico|avif|psd)"
WEB_FILE_NAME = r"(?i)^[\p{L}\p{N}_\-. ()\[\]]+\." + WEB_EXTENSION + "$"
WEB_HASH = r"(?i)^[0-9a-f]{8,}(\." + WEB_EXTENSION + ")?$"
TAG = r"<[^>]+>"
CHARSET = r"""(?i)charset=["']?([\w\-]+)"""
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CRITERION = r"\b([1-4]\.\d+\.\d+)\b"
URL_START = r"^(https?://|www\.|ftp://|mailto:)"
CONTROL_RUN = r"[\x00-\x1f\x7f\p{Cf}]+"
ROLE_MARKERS = (
    r"(?i)\b(system|assistant|user|human)\s*:",
    r"<\|[^|>]*\|>",
    r"(?m)^\s*#{2,}",
    r"```",
    r"(?i)\[/?(INST|SYS)\]",
)
REMOVED = "[removido]"
SANITIZE_LIMIT, SANITIZE_CUT = 500, "[...]"
STYLE_HEADING = r"^(?:heading|titulo|ttulo)([1-9])$"
EDGE_QUOTES = "\"'“”‘’ "

# -------------------------------------------------------- fixed values: package namespaces
NS = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "urn:schemas-microsoft-com:vml": "v",
    "urn:schemas-microsoft-com:office:office": "o",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
}
HYPERLINK_TYPE = (
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink")
DOCUMENT_PART, STYLES_PART, PROPERTIES_PART = (
    "word/document.xml", "word/styles.xml", "docProps/core.xml")
