"""Word lists, patterns, weights and vocabularies.

Everything in this module is a fixed value that results depend on. Patterns are written for
Java's regex engine; ``JAVA_WORDS`` makes ``\\b`` and ``\\w`` follow Unicode letters.
"""

from __future__ import annotations

JAVA_WORDS = "(?iU)"

# ---------------------------------------------------------------- fixed values: identifiers
HYPHENS = "-‐‑–"
CVE_ID = r"^CVE-\d{4}-\d{4,7}$"
CVE_IN_TEXT = rf"(?iU)\bCVE[{HYPHENS}](\d{{4}})[{HYPHENS}](\d{{4,7}})\b"
TECHNIQUE_IN_TEXT = r"(?U)\b(T1\d{3}(?:\.\d{3})?)\b"
EDB_IN_TEXT = r"(?iU)\bEDB[-\s]?(?:ID[:\s]*)?(\d{3,6})\b"
URL_IN_TEXT = r"https?://[^\s;<>\"']+"
REPOSITORY_NAME = r"^[A-Za-z0-9_.-]{1,100}/[A-Za-z0-9_.-]{1,100}$"
RULE_TECHNIQUE_TAG = r"(?i)^attack\.(t[0-9]{4}(?:\.[0-9]{3})?)$"
RULE_CVE_TAG = r"(?i)^cve\.([0-9]{4})[-.]([0-9]{4,})$"

# ---------------------------------------------------------------- fixed values: reporting words
EXPLOITATION_WORDS = (
    r"actively exploit(?:ed|ing)|under active exploitation|in-the-wild exploitation|"
    r"exploit(?:s|ed|ing|ation)[^.\n]{0,60}?in the wild|"
    r"exploitation (?:has been|was) (?:detected|observed)|zero-day|0-day|exploited as a zero|"
    r"known to be exploited|attacks exploiting|(?:hackers|attackers|adversaries) (?:are )?exploit|"
    r"exploit(?:ed|ing|s) (?:the )?(?:flaw|bug|vulnerabilit|CVE-)"
)
RANSOMWARE_WORD = r"\bransomware\b"

# ---------------------------------------------------------------- fixed values: impact keywords
IMPACT_WORDS = {
    "rce": r"remote code execution|arbitrary code execution|execute arbitrary (?:code|commands)|"
           r"code injection|command injection|\bRCE\b|deserializ",
    "privilege_escalation": r"privilege escalation|elevation of privilege|escalate privileges|"
                            r"gain (?:root|system|elevated) privileges|\bEoP\b|\bLPE\b",
    "auth_bypass": r"authentication bypass|bypass (?:the )?authentication|missing authentication|"
                   r"unauthenticated (?:attacker|access)|improper authentication|auth bypass",
    "sqli": r"sql injection",
    "path_traversal": r"path traversal|directory traversal",
    "info_disclosure": r"information disclosure|sensitive information",
    "dos": r"denial[- ]of[- ]service",
    "memory_corruption": r"use[- ]after[- ]free|buffer overflow|out-of-bounds write|heap overflow|"
                         r"type confusion|memory corruption",
}
IMPACT_CWES = {
    "rce": ["CWE-94", "CWE-77", "CWE-78", "CWE-502", "CWE-95", "CWE-917", "CWE-1336", "CWE-434"],
    "privilege_escalation": ["CWE-269", "CWE-250", "CWE-266", "CWE-274", "CWE-648"],
    "auth_bypass": ["CWE-287", "CWE-288", "CWE-290", "CWE-294", "CWE-306", "CWE-302", "CWE-1390", "CWE-798"],
    "sqli": ["CWE-89"],
    "path_traversal": ["CWE-22", "CWE-23", "CWE-35"],
    "memory_corruption": ["CWE-416", "CWE-787", "CWE-119", "CWE-120", "CWE-122", "CWE-843"],
}

# ---------------------------------------------------------------- fixed values: platform keywords
PLATFORM_WORDS = {
    "windows": r"\bwindows\b|win32k|\bntlm\b|smbv?\d?\b|\blsass\b|\bmicrosoft\b",
    "linux": r"\blinux\b|\bkernel\b|\bglibc\b|\bubuntu\b|\bdebian\b|red ?hat|\bsudo\b|systemd",
    "macos": r"\bmacos\b|\bios\b|\bipados\b|\bwebkit\b|\bsafari\b|\bapple\b",
    "android": r"\bandroid\b|\bpixel\b",
    "cloud": r"\baws\b|amazon web services|\bazure\b|\bgcp\b|google cloud|kubernetes|\bs3\b|"
             r"\bentra\b|microsoft 365|\boffice 365\b|\bsaas\b|\bcloud\b",
    "active_directory": r"active directory|\bkerberos\b|domain controller|\bad cs\b|\badcs\b|"
                        r"\bldap\b|netlogon|group policy",
    "identity": r"\boauth\b|\bsaml\b|\boidc\b|openid|\bmfa\b|single sign-on|\bsso\b|\biam\b|"
                r"\bentra id\b|\bokta\b|identity provider",
    "web": r"\bweb\b|\bhttp\b|\bphp\b|wordpress|\bapache\b|\bnginx\b|\btomcat\b|\bjava\b|"
           r"cross-site|\bxss\b|\bsql injection\b|\bcms\b|confluence|jenkins|browser|chrome",
    "network": r"\brouter\b|\bfirewall\b|\bvpn\b|\bswitch\b|fortinet|fortigate|fortios|\bcisco\b|"
               r"palo alto|pan-os|juniper|ivanti|citrix|netscaler|sonicwall|f5 big-ip|zyxel|"
               r"\bgateway\b|draytek|tp-link|d-link|\bnetgear\b|\bcheck point\b",
}
INTERNET_FACING_WORDS = (
    r"\bvpn\b|firewall|gateway|pan-os|globalprotect|fortios|fortigate|fortiweb|fortimanager|forticlient ems|"
    r"netscaler|citrix adc|ivanti connect|pulse connect|sonicwall|big-ip|exchange server|sharepoint|"
    r"confluence|jira|gitlab|jenkins|moveit|goanywhere|crushftp|wordpress|apache|nginx|tomcat|"
    r"\bweb server\b|\bmail server\b|zimbra|roundcube|outlook web|\bowa\b|remote desktop|\brdp\b|"
    r"\bssh\b|openssh|vcenter|esxi|horizon|workspace one|asa\b|ios xe|\brouter\b|edge device|"
    r"load balancer|screenconnect|connectwise|teamcity|veeam|papercut|citrix"
)

# ---------------------------------------------------------------- fixed values: name dictionary
# Names that count only in their exact spelling.
CASE_SENSITIVE_NAMES = [
    "at", "net", "ping", "tor", "reg", "cmd", "expand", "page", "ftp", "arp", "route", "tasklist", "systeminfo",
    "whoami", "schtasks", "netsh", "esentutl", "ifconfig", "xcopy", "certutil", "wevtutil", "nltest",
    "empire", "komplex", "machete", "carbon", "turla", "rover", "prism", "ebury", "lucifer", "zox", "hydraq",
    "flame", "duqu", "regin", "kasidet", "sykipot", "mis-type", "misdat", "mosquito", "dust storm",
    "operation wocao", "cardinal rat", "bonadan", "sunburst", "raindrop", "doki", "p.a.s. webshell", "cuba",
    "royal", "play", "akira", "black basta", "hive", "conti", "lockbit", "maze", "ryuk", "egregor",
    "gold", "silver", "sibot", "goopy", "gazer", "orz", "remexi", "sword", "unknown", "matryoshka", "kinsing",
    "action rat", "agent tesla", "bumblebee", "ursnif", "emotet", "trickbot", "qakbot",
]
# Names that are ordinary words and never count.
NEVER_MATCH_NAMES = [
    "at", "net", "ping", "tor", "reg", "cmd", "expand", "page", "ftp", "arp", "route", "unknown",
    "gold", "silver", "play", "royal", "sword", "carbon", "prism", "flame", "rover", "hive", "maze",
    "cuba", "doki", "orz", "zox",
]
MIN_NAME_CHARS = 3
CASE_SENSITIVE_BELOW_CHARS = 6

# ---------------------------------------------------------------- fixed values: URLs and text
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"]
ACTIVE_BLOCK = r"(?is)<\s*(script|style|noscript|iframe|object|template)\b.*?<\s*/\s*\1\s*>"
LINE_END_TAG = r"(?i)<\s*(br|/p|/div|/li|/h[1-6]|/tr)\s*/?>"
FORMULA_PREFIXES = ["=", "+", "-", "@", "\t", "\r"]

# ---------------------------------------------------------------- fixed values: observables
PLACEHOLDERS = ["", "n/a", "none", "unknown", "null", "-"]
FAMILY_SUFFIX = r"(rat|stealer|loader|bot|trojan|ransomware|miner)$"
FORMAT_TAGS = [
    "exe", "dll", "ps1", "js", "jse", "vbs", "vbe", "bat", "cmd", "hta", "lnk",
    "elf", "apk", "jar", "msi", "scr", "zip", "rar", "7z", "gz", "tar", "iso",
    "img", "doc", "docx", "xls", "xlsx", "ppt", "rtf", "pdf", "sh", "py", "php",
    "html", "swf", "32-bit", "64-bit", "x86", "x64", "arm", "mips", "mipsel",
    "powershell", "office", "macro", "shellcode", "binary", "script", "text",
]
INDICATOR_KINDS = ["sha256", "md5", "sha1", "url", "domain", "ipv4"]

# ---------------------------------------------------------------- fixed values: repositories
DETECTION_WORDS = ["sigma", "yara", "nuclei", "detection", "detect", "hunting", "ioc", "snort", "suricata"]
SCANNER_WORDS = ["scanner", "scan", "checker", "check ", "vulnerability check", "mass test"]
POC_WORDS = ["exploit", "poc", "proof of concept", "proof-of-concept", "rce", "payload", "reproduc"]

# ---------------------------------------------------------------- fixed values: attack knowledge
STIX_TYPES = {
    "attack-pattern": "technique",
    "x-mitre-tactic": "tactic",
    "intrusion-set": "group",
    "malware": "malware",
    "tool": "tool",
    "campaign": "campaign",
    "course-of-action": "mitigation",
    "x-mitre-data-source": "data_source",
    "x-mitre-data-component": "data_component",
    "x-mitre-detection-strategy": "detection_strategy",
    "x-mitre-analytic": "analytic",
}
KEPT_RELATIONSHIPS = ["uses", "mitigates", "detects", "subtechnique-of", "attributed-to", "revoked-by"]
MITRE_REFERENCE_SOURCES = ["mitre-attack", "mitre-ics-attack", "mitre-mobile-attack"]
NAMED_TYPES = ["group", "malware", "tool", "campaign"]

HEURISTIC_TECHNIQUES = {
    "T1190": "Internet-facing product with RCE / auth-bypass impact → Exploit Public-Facing Application",
    "T1068": "Privilege-escalation impact → Exploitation for Privilege Escalation",
    "T1203": "Client-side code execution (browser/document/app) → Exploitation for Client Execution",
    "T1212": "Credential exposure/bypass → Exploitation for Credential Access",
    "T1211": "Security feature bypass → Exploitation for Defense Evasion",
    "T1210": "Network service RCE on internal protocol → Exploitation of Remote Services",
}
CLIENT_SIDE_WORDS = ["browser", "chrome", "webkit", "office", "word", "excel", "reader", "document", "file",
                     "outlook", "mail client"]
CREDENTIAL_WORDS = ["credential", "password", "ntlm hash", "token"]
FEATURE_BYPASS_WORDS = ["security feature bypass", "mark of the web", "smartscreen"]
INTERNAL_SERVICE_WORDS = ["smb", "rdp", "rpc", "remote desktop"]

# ---------------------------------------------------------------- fixed values: score weights
WEIGHTS = {
    "kev": 25,
    "active_exploitation": 15,
    "ransomware": 10,
    "public_exploit": 12,
    "public_poc": 8,
    "threat_actor": 8,
    "rce": 8,
    "auth_bypass": 7,
    "privilege_escalation": 5,
    "internet_facing": 6,
    "cvss_max": 10,
    "sources_per_extra": 3,
    "sources_max": 9,
    "recent_7d": 8,
    "recent_30d": 4,
    "products_5": 3,
    "products_20": 5,
}
FOCUSED_MAX_CVES = 5

# ---------------------------------------------------------------- fixed values: inventory matching
STATES = ["affected", "possibly_affected", "not_affected"]
REACHING_STATES = ["affected", "possibly_affected"]
EXPOSURE = {"affected": 40, "possibly_affected": 15, "not_affected": 0}
STATE_LABELS = {"affected": "Affected", "possibly_affected": "To check", "not_affected": "Ruled out"}
STATE_TITLES = {"affected": "Affected", "possibly_affected": "Possibly affected — check by hand",
                "not_affected": "Ruled out"}
ASSET_CATEGORIES = ["firewall", "switch", "storage", "hypervisor", "os", "application", "other"]
MAX_ASSETS = 500

# ---------------------------------------------------------------- fixed values: reading surface
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNSCORED"]
WINDOW_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24, "90d": 90 * 24, "1y": 365 * 24}
RULE_LEVELS = ["informational", "low", "medium", "high", "critical"]
RULE_STATUSES = ["stable", "test", "experimental", "deprecated", "unsupported"]

BACKOFF_CAP_SECONDS = 6 * 3600
BACKOFF_MAX_DOUBLINGS = 6
STALE_AFTER_INTERVALS = 4
FEED_EXCERPT_CHARS = 600
RELINK_DAYS = 60

KEV_CATALOGUE_URL = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog"
NVD_DETAIL_URL = "https://nvd.nist.gov/vuln/detail/"
CVE_RECORD_URL = "https://www.cve.org/CVERecord?id="

# ---------------------------------------------------------------- fixed values: labels
TAG_LABELS = {
    "rce": "Remote code execution",
    "privilege_escalation": "Privilege escalation",
    "auth_bypass": "Authentication bypass",
    "sqli": "SQL injection",
    "path_traversal": "Path traversal",
    "memory_corruption": "Memory corruption",
    "info_disclosure": "Information disclosure",
    "dos": "Denial of service",
}
PLATFORM_LABELS = {
    "windows": "Windows",
    "linux": "Linux",
    "macos": "macOS",
    "android": "Android",
    "cloud": "Cloud",
    "active_directory": "Active Directory",
    "identity": "Identity",
    "web": "Web",
    "network": "Network",
}
