"""Word lists, patterns and cut points.

Fixed values: results depend on these exact entries, so they are kept together, as text.
"""

FORMULAIC = (
    "i hope this email finds you well",
    "i hope this message finds you well",
    "we are excited to announce",
    "please be advised",
    "we would like to inform you",
    "thank you for your understanding",
    "at your earliest convenience",
    "do not hesitate to contact us",
    "in today's fast-paced world",
    "unlock the full potential",
    "tailored to meet your needs",
    "comprehensive solution",
    "seamless experience",
    "cutting-edge",
    "state-of-the-art",
    "it is important to note",
    "we appreciate your patience",
    "настоящим сообщаем",
    "настоящим уведомляем",
    "обращаем ваше внимание",
    "рады сообщить",
    "мы рады сообщить",
    "благодарим за понимание",
    "для вашего удобства",
    "с целью повышения",
    "комплексное решение",
    "индивидуальный подход",
    "широкий спектр услуг",
    "уникальная возможность",
    "в современном мире",
    "позвольте представить",
    "не стесняйтесь обращаться",
    "в случае возникновения вопросов",
    "для получения дополнительной информации",
    "в целях обеспечения",
)

TRANSITIONS = (
    "furthermore",
    "moreover",
    "additionally",
    "consequently",
    "in conclusion",
    "it is worth noting",
    "следует отметить",
    "таким образом",
    "кроме того",
    "более того",
    "в заключение",
    "в дополнение",
)

GENERIC = (
    "solution",
    "approach",
    "opportunity",
    "benefits",
    "experience",
    "platform",
    "innovative",
    "customer needs",
    "various services",
    "value proposition",
    "решение",
    "возможность",
    "преимущества",
    "опыт",
    "платформа",
    "инновационный",
    "потребности клиентов",
    "широкий спектр",
    "ценность",
)

INDICATORS = (
    "urgent",
    "immediately",
    "verify",
    "password",
    "account",
    "confirm",
    "срочно",
    "немедленно",
    "подтвердите",
    "парол",
    "аккаунт",
    "заблокирован",
    "настоящим сообщаем",
    "уважаемый клиент",
    "hereby inform",
)

SUBJECT_STOPWORDS = (
    "the", "and", "for", "with", "from", "your", "you", "our", "this", "that", "are", "was", "were",
    "have", "has", "will", "please", "about", "into", "для", "как", "что", "это", "при", "или", "вам",
    "ваш", "ваша", "ваши", "мы", "вы", "они", "его", "ее", "её", "над", "под", "про",
)

AUTOMATION = (
    "out of office",
    "automatic reply",
    "auto-reply",
    "automated message",
    "delivery status notification",
    "failure notice",
    "mail delivery subsystem",
    "this is an automatically generated",
    "newsletter subscription",
    "bugzilla notification",
    "cvs commit notification",
)

SIGN_OFF = (
    "best regards",
    "kind regards",
    "warm regards",
    "regards",
    "sincerely",
    "yours truly",
    "respectfully",
    "с уважением",
    "с наилучшими пожеланиями",
    "с благодарностью",
)

GREETING_START = r"(?iU)^(?:hi\b|hey\b|hello\b|dear\b|good (?:morning|evening|afternoon)\b|здравств\p{L}*|добр\p{L}*|привет\p{L}*|хай\b|уважаем\p{L}*|коллеги\b|всем привет)"
SIGN_OFF_START = r"(?iU)^(?:--\s*$|с уважением\b|с наилучшими\b|всего доброго\b|best regards\b|kind regards\b|regards\b|sincerely\b|cheers\b)"
CONTACT = r"(?iU)(?:[\w.+-]@[\w.-]+\.\w+|\+\d[\d ()-]{6,}|(?:тел|phone|tel)\s*[:.])"

POSITIVE_LABELS = ("1", "true", "ai", "yes")
NEGATIVE_LABELS = ("0", "false", "human", "no")

#: Upper bounds of the five-way verdict.
VERDICTS = ((0.2, "DEFINITELY_HUMAN"), (0.4, "PROBABLY_HUMAN"), (0.6, "MIXED"), (0.8, "PROBABLY_AI"), (1.01, "DEFINITELY_AI"))

CHARSET_ALIASES = {
    "cp1251": "windows-1251",
    "1251": "windows-1251",
    "windows1251": "windows-1251",
    "utf8": "utf-8",
    "utf_8": "utf-8",
    "ks_c_5601-1987": "cp949",
    "gb2312": "gb18030",
    "gbk": "gb18030",
    "unknown-8bit": None,
    "x-unknown": None,
    "user-defined": None,
    "default": None,
    "ansi_x3.110-1983": "cp1252",
}
REPAIRABLE_CHARSETS = ("windows-1251", "cp1251", "koi8-r", "koi8-u", "cp1252", "latin-1", "iso-8859-1")

DANGEROUS_SCHEMES = ("javascript", "vbscript", "data", "blob")
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif")
PLACEHOLDER_KEYS = ("", "your_key", "your_api_key_here", "changeme", "replace_me", "sk-xxx", "sk-your-key")

KINDS = ("subject", "greeting", "body", "signature")

# Limits.
SEMANTIC_CHARS, SEGMENTS, PREVIEW, LEAST_WORDS = 100_000, 50, 500, 8
RAW_MAIL_BYTES, ZONE_MAIL_BYTES, IMAGE_BYTES, IMAGES = 25 * 1024 * 1024, 5 * 1024 * 1024, 6 * 1024 * 1024, 8
NEAR_SENTENCES, NEAR_JACCARD = 40, 0.82

# What a generation task draws from.
TASK_LISTS = {
    "topic": ("changing a meeting time", "clarifying a previous request", "project updates", "asking for help with a technical issue", "planning a visit", "sending a reminder", "asking a colleague a question", "inviting a friend", "following up on a purchase", "explaining a delay", "discussing classwork", "coordinating travel", "responding to a complaint", "sharing event details", "asking for feedback", "requesting a document", "organizing a group activity", "reporting a small problem", "apologizing for a mix-up", "giving informal advice", "rescheduling a call", "asking for clarification about deadlines", "replying about an appointment", "thanking a teammate", "describing a weekend plan", "chatting about hobbies", "arranging a delivery", "requesting information about a service"),
    "style": ("warm and informal", "direct and practical", "somewhat rushed", "polite and professional", "very short sentences", "slightly disorganized", "friendly with colloquialisms", "matter-of-fact", "chatty", "reserved", "casual but respectful", "straight to the point"),
    "role": ("student", "colleague", "team lead", "customer", "classmate", "neighbor", "family friend", "volunteer", "organizer", "support agent", "club member", "freelancer", "community member"),
    "recipient": ("a close friend", "a professor", "a coworker", "a small group", "a new client", "an acquaintance", "a teammate", "a service provider", "a project manager", "a neighbor"),
    "detail": ("a last-minute complication", "a misread calendar entry", "a missing attachment", "a slight disagreement", "a suggested alternative", "a tight deadline", "an unexpectedly good outcome", "a practical concern", "an update after an earlier reply", "a small favor", "an unclear instruction", "a conflicting commitment", "a follow-up after two days", "a time-sensitive change", "a helpful suggestion", "an unfinished task", "a travel disruption", "a change in priorities", "an unanticipated expense", "a small technical issue"),
    "format": ("with a greeting but no signature", "with a short sign-off", "without a greeting", "with ordinary paragraph breaks", "as a reply to an earlier conversation", "with a subject and a single paragraph"),
}
TASK_WORDS = (45, 250)
