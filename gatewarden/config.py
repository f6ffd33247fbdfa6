"""Parameters of the rules; every one can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: patterns, lists and scores that results must agree on, stated as they are ----

NEGATIVE_PROMPT = (
    r"\b(wtf|wth|ffs|omfg|shit(ty|tiest)?|dumbass|horrible|awful|piss(ed|ing)? off|piece of (shit|crap|junk)|"
    r"what the (fuck|hell)|fucking? (broken|useless|terrible|awful|horrible)|fuck you|screw (this|you)|"
    r"so frustrating|this sucks|damn it)\b"
)
BAD_USER_AGENT = r"\b(curl|wget|python-requests|bot|spider|crawler|scrapy|headless|selenium|phantomjs|httpclient)\b"
SCAM_WORDS = "(hack|bitcoin|generator|credit card|loan|scam|earn money fast|click here)"
RISKY_ASNS = (9009, 14061, 16276, 20473, 24940)
UA_REASONS = ("bad_user_agent", "publisher_bad_ua_rate")
BURST_REASONS = ("ip_burst", "session_burst", "publisher_burst", "regular_cadence")
TERMS = (
    "free money", "win prize", "lottery winner", "crypto giveaway", "wire transfer", "western union", "nigerian prince",
    "inheritance claim", "double your money", "double your bitcoin", "instant payout", "guaranteed profit",
    "credit card details", "recovery phrase", "seed phrase", "kill yourself", "kill myself", "go die", "you are worthless",
    "you are useless", "end my life", "end your life", "cut myself", "self harm", "buy followers", "cheap likes", "dan mode",
    "ignore instructions", "ignore all instructions", "ignore previous instructions",
)
CATEGORY_WORDS = {
    "SCAM": ("bitcoin generator", "credit card", "free money", "guaranteed profit", "crypto giveaway", "earn money fast", "scam", "instant payout", "double your money"),
    "JAILBREAK": ("ignore all instructions", "developer mode", "dan mode", "jailbreak", "bypass safety", "no rules", "uncensored"),
    "PROMPT_INJECTION": ("system prompt", "reveal prompt", "ignore system instructions", "override instructions", "new instructions", "prompt injection", "policy bypass"),
    "SPAM": ("click here", "buy now", "limited time offer", "act now", "exclusive deal", "free trial", "subscribe now", "winner", "promo code"),
    "PHISHING": ("verify account", "reset password", "confirm password", "login here", "secure your account", "bank account", "wallet seed phrase", "recovery phrase", "social security", "gift card"),
    "NSFW": ("nude", "porn", "explicit sex", "sexual content", "onlyfans", "nsfw", "erotic", "xxx"),
}
#: Countries in which a language is expected.
LANGUAGE_COUNTRIES = {
    "arabic": ("AE", "BH", "DZ", "EG", "IQ", "JO", "KW", "LB", "LY", "MA", "OM", "QA", "SA", "SD", "SY", "TN", "YE"),
    "chinese": ("CN", "HK", "MO", "SG", "TW"),
    "czech": ("CZ",),
    "danish": ("DK",),
    "dutch": ("BE", "NL", "SR"),
    "finnish": ("FI",),
    "french": ("BE", "CA", "CH", "FR", "LU", "MC", "SN", "CI", "CM", "MA", "DZ", "TN"),
    "german": ("AT", "CH", "DE", "LI", "LU"),
    "greek": ("CY", "GR"),
    "hebrew": ("IL",),
    "hindi": ("IN",),
    "hungarian": ("HU",),
    "indonesian": ("ID",),
    "italian": ("CH", "IT", "SM", "VA"),
    "japanese": ("JP",),
    "korean": ("KR",),
    "malay": ("BN", "MY", "SG"),
    "norwegian": ("NO",),
    "polish": ("PL",),
    "portuguese": ("AO", "BR", "CV", "GW", "MZ", "PT", "ST", "TL"),
    "romanian": ("MD", "RO"),
    "russian": ("BY", "KG", "KZ", "RU"),
    "spanish": ("AR", "BO", "CL", "CO", "CR", "CU", "DO", "EC", "ES", "GQ", "GT", "HN", "MX", "NI", "PA", "PE", "PR", "PY", "SV", "UY", "VE"),
    "swedish": ("FI", "SE"),
    "thai": ("TH",),
    "turkish": ("CY", "TR"),
    "ukrainian": ("UA",),
    "vietnamese": ("VN",),
}
LANGUAGE_ALIASES = {
    "en": "english", "eng": "english", "es": "spanish", "spa": "spanish", "fr": "french", "de": "german", "it": "italian", "pt": "portuguese",
    "ru": "russian", "ja": "japanese", "jp": "japanese", "ko": "korean", "zh": "chinese", "ar": "arabic", "hi": "hindi", "tr": "turkish", "nl": "dutch",
    "pl": "polish", "uk": "ukrainian", "sv": "swedish", "no": "norwegian", "da": "danish", "fi": "finnish", "el": "greek", "ro": "romanian",
    "hu": "hungarian", "he": "hebrew", "th": "thai", "vi": "vietnamese", "id": "indonesian", "ms": "malay", "cs": "czech",
}
FIRST_OCTETS = (23, 34, 45, 52, 63, 72, 81, 91, 104, 118, 129, 141, 151, 163, 185, 193, 203)
ASN_BASE = {"US": 70_000, "GB": 71_000, "CA": 72_000, "AU": 73_000, "DE": 74_000, "FR": 75_000, "ES": 76_000, "IT": 77_000, "NL": 78_000, "NO": 79_000, "SE": 80_000, "IN": 81_000, "BR": 82_000, "JP": 83_000}
#: Score of each rule in hundredths; the order is the order of reasons.
SCORES = {
    "negative_prompt": 15, "bad_user_agent": 30, "asn_risk": 20, "geo_language_mismatch": 45,
    "session_burst": 40, "regular_cadence": 25, "session_ip_churn": 40, "session_country_hop": 50, "session_asn_churn": 40, "session_ua_churn": 35, "prompt_replay": 45,
    "publisher_burst": 50, "publisher_suspicious_rate": 25, "publisher_bad_ua_rate": 30, "publisher_new_ip": 5, "publisher_new_session": 3, "publisher_dispersed_farm": 20,
    "publisher_burst_volume": 35, "publisher_prompt_replay": 10, "publisher_geo_diversity": 25, "publisher_ua_rotation": 20, "publisher_slow_prompt_replay": 10,
    "ip_burst": 35,
}
#: Layout of a line of the detector's log.
LOG_PREFIX = "[flink-fraud]"
LOG_LINE = r"\[flink-fraud\] (CLEAN|SUSPICIOUS|FRAUD) req_id=(\S+) score=([\d.]+) reasons=(.*?) -> (\S+)"
#: Reasons of the threshold sweep in the order of its weights, their weights in hundredths, and the weights tried by place.
SWEEP_REASONS = ("publisher_new_ip", "publisher_new_session", "publisher_dispersed_farm", "prompt_replay", "publisher_suspicious_rate", "session_burst", "publisher_burst_volume", "regular_cadence", "publisher_burst", "session_ip_churn", "session_asn_churn", "geo_language_mismatch", "session_country_hop", "negative_prompt")
SWEEP_BASE = [5, 3, 45, 15, 15, 40, 35, 30, 50, 40, 40, 15, 50, 15]
SWEEP_VARY = {11: [15, 25, 35, 50], 4: [15, 20, 25, 35], 3: [15, 25, 35], 7: [30, 40, 50], 2: [45, 30, 20, 10], 6: [35, 40, 50]}
SWEEP_SUSPICIOUS, SWEEP_FRAUD = [35, 40, 45], [50, 55, 60, 65, 70]
#: Publishers of the generated data set and their profiles.
PUBLISHERS = {
    "publisher_bad_01": "fully_abusive", "publisher_mild_01": "mildly_abusive", "publisher_mild_02": "mildly_abusive", "publisher_mild_03": "mildly_abusive",
    "publisher_blend_01": "mostly_clean", "publisher_blend_02": "mostly_clean", "publisher_blend_03": "mostly_clean", "publisher_blend_04": "mostly_clean",
} | {f"publisher_clean_{i:02d}": "clean" for i in range(1, 13)}
USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/605.1.15 Version/17.4 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 Mobile/15E148",
)
ROTATING_AGENTS = (*USER_AGENTS, "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/124.0.6367 Mobile Safari/537.36")
MISMATCHES = (("Chinese", "US"), ("Russian", "GB"), ("Japanese", "FR"), ("Korean", "DE"), ("French", "JP"), ("German", "BR"), ("Spanish", "CN"), ("Italian", "IN"), ("Portuguese", "KR"), ("Arabic", "SE"))
#: Attack families: sessions, rows per session (least, most), seconds between sessions (least, most; times the session's number), seconds between rows of a session (least, most; times the row's number).
ATTACKS = {
    "slow_promp_replay": (200, (8, 8), (40, 200), (2, 8)),
    "session_farm": (500, (4, 4), (10, 30), (3, 8)),
    "ua_rotation": (200, (6, 6), (20, 120), (2, 6)),
    "geo_mismatch": (200, (5, 5), (30, 180), (2, 8)),
    "regular_cadence": (200, (4, 4), (60, 60), (2, 2)),
    "publisher_burst": (16, (100, 100), (2, 2), (1.2, 1.2)),
    "slow_distributed_abuse": (1200, (1, 2), (0, 21600), (5, 15)),
}
PASSED_TOPIC = "ad.injection"
TOPICS = {"clean": "requests.clean", "suspicious": "requests.sus", "fraud": "requests.fraud"}


@dataclass(frozen=True)
class RuleConfig:
    """Windows in seconds and thresholds of the look-back rules; ``scale`` stretches every window."""

    scale: float = 1.0
    suspicious: int = 30
    fraud: int = 70
    session_burst_s: int = 60
    session_burst_max: int = 12
    churn_s: int = 120
    churn_min: int = 2
    country_max: int = 2
    cadence_s: int = 60
    cadence_drift_ms: int = 250
    replay_s: int = 300
    replay_ratio: float = 0.9
    publisher_burst_s: int = 300
    publisher_burst_max: int = 200
    volume_min: int = 20
    volume_ratio: float = 6.0
    rate_s: int = 600
    rate_min: int = 30
    rate_share: float = 0.10
    dispersion_s: int = 1800
    farm_ratio: float = 0.80
    prompt_s: int = 600
    prompt_min: int = 2
    slow_prompt_s: int = 1800
    slow_prompt_min: int = 3
    geo_s: int = 600
    geo_min: int = 5
    rotation_s: int = 600
    rotation_min_uas: int = 3
    rotation_min_requests: int = 10
    ip_burst_s: int = 60
    ip_burst_max: int = 8
    compat: bool = True  # the rules as they are coded; False: as they are documented
    scores: dict = field(default_factory=lambda: dict(SCORES))

    def ms(self, name: str) -> int:
        return int(getattr(self, name) * 1000 * self.scale)
