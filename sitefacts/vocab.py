"""Fixed values.

Word lists, host lists, patterns and lookup values that decide results. All of them are defaults of
parameters: a caller may pass other lists to every job. None of them grows with the data.
"""

# --- fixed values: hosts -------------------------------------------------------------------------
SECOND_LEVEL_TLDS = ("co", "com", "org", "net", "gov", "edu")
BLOCKED_HOST = "reg.ru"
SHORT_LINK_HOST = "clck.ru"
CHAT_WIDGET_HOST = "jivo.chat"
HH_HOST = "hh.ru"
MAX_HOST = "max.ru"
DZEN_HOST = "dzen.ru"
DRIVE2_HOST = "drive2.ru"
TELEGRAM_HOSTS = ("t.me", "telegram.me")
INSTAGRAM_HOSTS = ("instagram.com", "instagr.am")
VIDEO_HOSTS = (
    "rutube.ru", "youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "twitch.tv",
    "video.mail.ru", "smotrim.ru",
)
SOCIAL_HOSTS = (
    "vk.com", "vkontakte.ru", "ok.ru", "instagram.com", "facebook.com", "fb.com", "x.com",
    "twitter.com", "linkedin.com", "pinterest.com", "tiktok.com", "threads.net", "t.me",
    "telegram.me", "max.ru", "dzen.ru",
)
BOOKING_PROVIDERS = (
    ("yclients", ("yclients.com", "alteg.io", "altegio.com", "altegio.ru")),
    ("dikidi", ("dikidi.net", "dikidi.ru")),
    ("medflex", ("medflex.ru",)),
    ("docdoc", ("docdoc.ru", "sberhealth.ru")),
    ("napopravku", ("napopravku.ru",)),
    ("prodoctorov", ("prodoctorov.ru",)),
    ("bitrix24_forms", ("bitrix24.ru", "bitrix.info")),
    ("amocrm_forms", ("amocrm.ru", "amoforms.com")),
    ("infoclinica", ("infoclinica.ru",)),
)
MAJOR_MAIL_HOSTS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com",
    "yahoo.ru", "yahoo.co.uk", "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me",
    "mail.ru", "inbox.ru", "list.ru", "bk.ru", "yandex.ru", "yandex.com", "ya.ru",
)
FIRM_LINK_PREFIXES = ("http://link.2gis.ru/", "https://link.2gis.ru/")

# --- fixed values: paths and queries -------------------------------------------------------------
TRACKING_KEYS = ("utm_campaign", "utm_content", "utm_medium", "utm_source")
BINARY_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".pdf", ".doc", ".docx", ".xls",
    ".xlsx", ".zip", ".rar", ".7z", ".mp4", ".avi", ".mov", ".mp3", ".wav", ".xml",
)
INSTAGRAM_SERVICE_PATHS = (
    "about", "accounts", "api", "ar", "blog", "business", "challenge", "developer", "direct",
    "directory", "explore", "graphql", "help", "invites", "legal", "oauth", "p", "privacy", "reel",
    "reels", "stories", "terms", "tv", "web",
)
TELEGRAM_SERVICE_PATHS = (
    "share", "socks", "proxy", "login", "iv", "addstickers", "setlanguage", "invoice",
)
CRAWL_HINTS = (
    "contact", "contacts", "kontakty", "kontakti", "kontakt", "requisite", "requisites", "rekvizity",
    "rekvizit", "legal", "about", "o-kompanii", "company", "контакт", "контакты", "реквизит",
    "реквизиты", "юрид", "о компании", "price", "pricing", "prices", "service", "services",
    "stoimost", "cost", "ceny", "tseny", "prays", "price-list", "цены", "цена", "прайс",
    "прайс-лист", "стоимость", "услуги", "doctor", "doctors", "team", "staff", "specialist",
    "specialists", "vrachi", "personnel", "врач", "врачи", "команда", "персонал", "специалист",
    "специалисты", "booking", "appointment", "record", "zapis", "онлайн запис", "запис",
)

# --- fixed values: booking -----------------------------------------------------------------------
BOOKING_TEXT_HINTS = (
    "запис", "онлайн запис", "запись на прием", "запись к врачу", "appointment", "book appointment",
    "online booking", "schedule appointment",
)
BOOKING_URL_HINTS = (
    "booking", "appointment", "book", "schedule", "record", "zapis", "online-record", "online-zapis",
)
BOOKING_FIELD_HINTS = (
    "name", "phone", "email", "date", "time", "doctor", "service", "patient", "имя", "тел", "почт",
    "дата", "время", "врач", "услуг", "пациент",
)
LINK_ATTRIBUTES = (
    "href", "src", "action", "data-url", "data-href", "data-src", "data-widget-url", "data-form-url",
    "data-booking-url",
)

# --- fixed values: page scopes -------------------------------------------------------------------
FOOTER_HINTS = ("footer", "подвал", "контакт", "contact", "requisite", "реквизит", "legal", "copyright")
CARD_HINTS = (
    "doctor", "doctors", "team", "staff", "employee", "specialist", "врач", "команд", "персонал",
    "специал",
)
STAFF_PAGE_HINTS = (
    "врачи", "врач", "специалисты", "команда", "персонал", "doctors", "doctor", "team", "staff",
)
STAFF_TEXT_HINTS = ("наши врачи", "специалисты", "команда врачей")
ROLE_WORDS = (
    "главный врач", "врач", "стоматолог", "терапевт", "хирург", "ортопед", "ортодонт", "имплантолог",
    "пародонтолог", "гигиенист", "детский стоматолог", "администратор", "ассистент",
    "челюстно-лицевой хирург", "prosthodontist", "orthodontist", "dentist", "doctor", "surgeon",
    "assistant",
)
NOT_PERSON_WORDS = (
    "клиника", "клиники", "стоматология", "стоматологии", "центр", "правительства", "постановление",
    "улица", "проспект", "карла", "маркса", "бердске", "южная", "корея", "гарантия", "шаг", "если",
    "вы", "телефон", "имя", "выберите",
)

# --- fixed values: patterns ----------------------------------------------------------------------
PHONE_PATTERN = r"(?:\+7|8)\s*\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
ANY_PHONE_PATTERN = r"\+?\d[\d\s()\-]{8,}\d"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
AMOUNT_PATTERN = r"(?:\d{1,3}(?:[ \x{00A0}.,]\d{3})+|\d{2,7})"
CURRENCY_PATTERN = r"(?:₽|руб(?:\.|лей|ля)?|р(?![0-9A-Za-zА-Яа-яЁё_]))"
REVENUE_PATTERN = r"(\d[\d\s\x{00A0}.,]*)\s*(RUB|USD|EUR|₽|руб(?:\.|лей|ля)?|\$|€)"
UUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NUMBER_PATTERN = r"[-−]?\d[\d\s\x{00A0}]*(?:[.,]\d+)?"
REGISTRY_CODE_PATTERN = r"(?:taxpayer-id|org-inn|inn|tax-id|taxid|vat-id|vat_id|code)\s*[:\s]+\s*(\d{10,12})"
STRICT_EMAIL = r"^[a-z0-9][a-z0-9._+\-]*@[a-z0-9.\-]+\.[a-z]{2,}$"
CHECKED_EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
LOOSE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MASK_CHARS = "•*●◦·"
TAX_ID_LENGTHS = (10, 12)

# --- fixed values: domain owners -----------------------------------------------------------------
PRIVACY_WORDS = (
    "privacy", "redacted", "withheld", "protected", "proxy", "whoisguard", "domainprotect",
    "contactprivacy", "anonymize",
)
LEGAL_KEYWORDS = (
    "llc", "ltd", "inc", "corp", "corporation", "limited", "gmbh", "s.a.", "s.r.o.", "bv", "nv", "ag",
    "plc", "llp", "lp", "co.", "company", "group", "holding", "holdings", "enterprises", "solutions",
    "technologies", "services", "systems", "software", "networks", "media", "communications", "bank",
    "financial", "insurance", "foundation", "association", "institute", "university", "college",
    "school", "hospital", "clinic", "government", "ооо", "оао", "зао", "пао", "ао", "ип", "нко",
    "фгуп", "гуп", "муп", "тов", "тдв", "пат", "пбоюл", "пк", "снт", "нпо", "нии", "фонд", "банк",
    "страховая", "страховое", "холдинг", "privacy", "redacted", "withheld", "protected", "proxy",
    "whoisguard", "domainprotect", "contactprivacy", "anonymize", "private registration",
    "data protected",
)
PERSON_NAME = r"(?i)^[A-ZА-ЯЁa-zа-яё]{2,}\s+[A-ZА-ЯЁa-zа-яё]{2,}(?:\s+[A-ZА-ЯЁa-zа-яё]{2,})?$"
OWNER_LABELS = (
    ("legal", "Юридическое лицо"), ("person", "Физическое лицо"), ("privacy", "Данные скрыты"),
    ("unknown", "Неизвестно"),
)
OWNER_REASONS = {
    "privacy": "Данные скрыты privacy-сервисом",
    "org_word": "Поле org содержит признак юр. лица",
    "org": "Поле org заполнено (без явных ключевых слов)",
    "name_word": "Имя регистранта содержит признак юр. лица",
    "name_person": "Имя соответствует шаблону ФИО физ. лица",
    "name": "Поле org пусто, имя не опознано как юр. лицо",
    "none": "Нет данных о регистранте",
}

# --- fixed values: address checks ----------------------------------------------------------------
CHECK_STATUSES = (
    "valid", "invalid", "catch_all", "skipped", "no_mx", "domain_error", "smtp_error", "syntax_error",
)

# --- fixed values: registry extracts -------------------------------------------------------------
EXECUTIVE_SECTION = (
    "сведения о лице, имеющем право без доверенности действовать от имени юридического лица"
)
FOUNDERS_SECTION = "сведения об участниках / учредителях юридического лица"
HEADING_STARTS = ("сведения о ", "сведения об ")
SURNAME_LABEL, NAME_LABEL, PATRONYMIC_LABEL = "Фамилия", "Имя", "Отчество"
ADDRESS_LABEL = "Адрес юридического лица"
EMAIL_LABEL = "Адрес электронной почты"

# --- fixed values: labelled profile sections -----------------------------------------------------
SECTION_LABELS = {
    "description": ("description", "описание"),
    "industries": ("industries", "индустрии", "отрасли"),
    "technologies": ("technologies", "технологии"),
    "website": ("website", "сайт"),
    "tin": ("taxpayer identification number", "tin", "инн"),
    "country": (
        "country of registration a legal entity or sole proprietorship",
        "country of registration legal entity or sole proprietorship",
        "страна регистрации",
    ),
    "legal_entity_name": (
        "legal entity or sole proprietorship",
        "юридическое лицо или ип",
        "юридическое лицо или индивидуальный предприниматель",
    ),
    "revenue": ("revenue", "выручка"),
    "contacts": ("contacts", "контакты"),
    "contact_name": (
        "full name of contact person", "full name contact person", "фио контактного лица",
        "контактное лицо",
    ),
    "contact_email": (
        "email of contact person", "email контактного лица", "электронная почта контактного лица",
    ),
    "contact_phone": (
        "mobile of contact person", "phone of contact person", "телефон контактного лица",
        "мобильный телефон контактного лица",
    ),
}
REVENUE_STOPS = ("pilots and contracts", "investment", "contacts", "пилоты", "инвестиции", "контакты")
REVENUE_SECTION_STOPS = ("contacts", "description", "industries", "technologies", "website")
CONTACT_STOPS = ("product", "company", "revenue", "pilots and contracts", "investment")
PAGE_FOOTER_START = "1997—"
IGNORED_EMAILS = ("sberunity@sberbank.ru",)

# --- fixed values: spelling ----------------------------------------------------------------------
LETTER_SPELLINGS = {
    "а": ("a",), "б": ("b",), "в": ("v",), "г": ("g", "h"), "д": ("d",), "е": ("e", "ye"),
    "ё": ("e", "yo"), "ж": ("zh",), "з": ("z",), "и": ("i",), "й": ("y", "i"), "к": ("k",),
    "л": ("l",), "м": ("m",), "н": ("n",), "о": ("o",), "п": ("p",), "р": ("r",), "с": ("s",),
    "т": ("t",), "у": ("u",), "ф": ("f",), "х": ("kh", "h"), "ц": ("ts", "c"), "ч": ("ch",),
    "ш": ("sh",), "щ": ("shch", "sch"), "ъ": ("",), "ы": ("y", "i"), "ь": ("",), "э": ("e",),
    "ю": ("yu", "iu"), "я": ("ya", "ia"),
}
FIRST_NAME_SPELLINGS = {
    "александр": ("alexandr", "aleksandr", "alexander"),
    "александра": ("alexandra", "aleksandra"),
    "алексей": ("alexey", "aleksey", "alexei", "aleksei"),
    "алена": ("alena", "alyona"),
    "андрей": ("andrey", "andrei"),
    "анна": ("anna",),
    "анастасия": ("anastasia", "anastasiya", "anastasiia"),
    "антон": ("anton",),
    "артем": ("artem", "artyom"),
    "артём": ("artem", "artyom"),
    "артур": ("artur", "arthur"),
    "вадим": ("vadim",),
    "валентин": ("valentin",),
    "валентина": ("valentina",),
    "валерий": ("valeriy", "valery", "valerii"),
    "вера": ("vera",),
    "виктор": ("viktor", "victor"),
    "виктория": ("viktoria", "victoria"),
    "виталий": ("vitaliy", "vitaly", "vitalii"),
    "владимир": ("vladimir",),
    "вячеслав": ("vyacheslav", "viacheslav"),
    "георгий": ("georgiy", "georgy", "george"),
    "дарья": ("darya", "daria"),
    "денис": ("denis",),
    "дмитрий": ("dmitriy", "dmitry", "dmitrii", "dmitri"),
    "евгений": ("evgeniy", "evgeny", "evgenii", "eugene"),
    "евгения": ("evgeniya", "evgenia"),
    "екатерина": ("ekaterina", "katerina"),
    "елена": ("elena", "yelena"),
    "иван": ("ivan",),
    "игорь": ("igor", "igorj"),
    "илья": ("ilya", "ilia"),
    "ирина": ("irina",),
    "кирилл": ("kirill", "cyrill"),
    "константин": ("konstantin", "constantine"),
    "кристина": ("kristina", "christina"),
    "ксения": ("kseniya", "ksenia", "xenia"),
    "максим": ("maksim", "maxim"),
    "мария": ("mariya", "maria"),
    "михаил": ("mikhail", "mihail", "michael"),
    "наталья": ("natalya", "natalia", "nataliya"),
    "никита": ("nikita",),
    "николай": ("nikolay", "nikolai"),
    "оксана": ("oksana", "oxana"),
    "олег": ("oleg",),
    "ольга": ("olga",),
    "павел": ("pavel", "paul"),
    "петр": ("petr", "pyotr", "peter"),
    "пётр": ("petr", "pyotr", "peter"),
    "роман": ("roman",),
    "светлана": ("svetlana",),
    "сергей": ("sergey", "sergei"),
    "станислав": ("stanislav",),
    "татьяна": ("tatyana", "tatiana"),
    "юлия": ("yuliya", "yulia", "iulia", "julia"),
    "юрий": ("yuriy", "yury", "yuri"),
}
ADDRESS_PATTERNS = (
    "first.last", "last.first", "first_last", "last_first", "first-last", "last-first", "firstlast",
    "lastfirst", "f.last", "last.f", "f_last", "last_f", "f-last", "last-f", "flast", "lastf",
    "first.l", "l.first", "first_l", "l_first", "first-l", "l-first", "firstl", "lfirst", "first",
    "last", "f.l", "l.f", "fl", "lf", "first.middle", "last.middle", "first.m", "last.m", "f.m.last",
    "last.f.m", "fmlast", "lastfm", "first.last.middle", "last.first.middle", "first.middle.last",
    "firstlastm", "lastfirstm",
)

# --- fixed values: tables ------------------------------------------------------------------------
PRICING_FIELDS = ("domain", "source_url", "service", "price_raw", "price_min", "price_max", "currency")
SPECIALIST_FIELDS = ("domain", "source_url", "full_name", "role", "phone", "email")
CONTACT_FIELDS = ("domain", "source_url", "source_scope", "inn", "ogrn", "ogrnip", "phones", "emails")
PROFILE_COLUMNS = (
    "hh_profile", "tg_profile", "max_profile", "vk_profile", "dzen_profile", "rutube_profile",
    "instagram_profile", "youtube_profile",
)
SITE_COLUMNS = ("site", "site_url", "website", "domain", "url")
TAX_ID_COLUMNS = ("inn", "ИНН", "company_inn")
