"""Rule tables of the audit: plain data, extended by passing more rows to the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sensitive:
    rule: str
    severity: str
    intent: str
    code_only: bool
    doc_severity: str | None
    bucket: str | None
    source: bool
    label: str
    regex: str


@dataclass(frozen=True)
class Behavioral:
    rule: str
    severity: str
    look_back: bool
    label: str
    regex: str


# Rule, severity, intent, skipped in .md, severity in .md, bucket, credential source,
# label, pattern.  The order decides which rule a decoded text counts for.
SENSITIVE = [
    Sensitive("VTD-0001", "critical", "negligent", False, None, None, False, 'Embedded private key', r'(?i)(?:BEGIN\s+(?:RSA|DSA|EC|OPENSSH)\s+PRIVATE\s+KEY)'),
    Sensitive("VTD-0002", "critical", "negligent", False, None, None, False, 'Potential API token detected', r'(?:ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{22,}|sk-[a-zA-Z0-9]{20,})'),
    Sensitive("VTD-0017", "critical", "negligent", True, None, None, False, 'Use of eval() — potential code injection risk', r'(?i)\beval\s*\('),
    Sensitive("VTD-0018", "critical", "negligent", True, None, None, False, 'Shell execution without sandboxing', r'(?i)(?:\bchild_process\b|(?:^|[^.\w])(?:exec|spawn|execSync|spawnSync|execFile|execFileSync)\s*\()'),
    Sensitive("VTD-0019", "critical", "negligent", True, None, None, False, 'Destructive file system operation', r'(?im)(?:^|[\s;&|])(?:rm\s+-rf|rmdir/s|del\s+/f)\s+(?:/|~|\.{1,2}(?:/|\s|$)|\*|\$[{(]?[A-Za-z_])'),
    Sensitive("VTD-0020", "critical", "malicious", True, None, 'EXECUTION', False, 'Remote code execution via pipe to shell', r'(?i)(?:curl|wget)\s+\S.*\|\s*(?:bash|sh|zsh|dash|ksh|python3?|node|perl|ruby)(?:\s|;|$)'),
    Sensitive("VTD-0020", "critical", "malicious", True, None, 'EXECUTION', False, 'Remote code execution via pipe to shell', r'(?i)(?:bash|sh|zsh|dash)\s+<\(\s*(?:curl|wget)\s'),
    Sensitive("VTD-0028", "critical", "negligent", True, None, None, False, 'Safety bypass flag detected', r'(?i)--no-verify'),
    Sensitive("VTD-0028", "low", "negligent", True, None, None, False, 'Safety bypass flag detected', r'(?i)--force'),
    Sensitive("VTD-0005", "critical", "negligent", False, "medium", None, True, 'Cloud credential file access', r'(?i)\.aws[/\\](?:credentials|config)\b'),
    Sensitive("VTD-0005", "critical", "negligent", False, "medium", None, True, 'Cloud credential file access', r'(?i)\.config[/\\]gcloud[/\\](?:application_default_credentials|credentials\.db|access_tokens\.db|legacy_credentials)'),
    Sensitive("VTD-0006", "critical", "negligent", False, "medium", None, True, 'SSH private key file access', r'(?i)\.ssh[/\\]id_(?:rsa|ed25519|ecdsa|dsa|ecdsa-sk|ed25519-sk)\b'),
    Sensitive("VTD-0007", "critical", "negligent", False, "medium", None, True, 'npm credential file access', r'(?i)~[/\\]\.npmrc\b'),
    Sensitive("VTD-0008", "critical", "negligent", False, "medium", None, True, 'PyPI credential file access', r'(?i)\.pypirc\b'),
    Sensitive("VTD-0009", "critical", "negligent", False, "medium", None, True, 'Docker credential file access', r'(?i)\.docker[/\\]config\.json\b'),
    Sensitive("VTD-0010", "critical", "negligent", False, "medium", None, True, 'Kubernetes credential file access', r'(?i)\.kube[/\\]config\b'),
    Sensitive("VTD-0011", "critical", "negligent", False, "medium", None, True, 'GitHub CLI credential file access', r'(?i)\.config[/\\]gh[/\\]hosts\.yml\b'),
    Sensitive("VTD-0012", "critical", "negligent", False, "medium", None, True, 'netrc credential file access', r'(?i)(?:~[/\\])?\.netrc\b'),
    Sensitive("VTD-0013", "critical", "negligent", False, "medium", None, True, 'macOS Keychain file access', r'(?i)Library[/\\]Keychains\b'),
    Sensitive("VTD-0014", "critical", "negligent", False, "medium", None, False, 'Windows credential store access', r'(?i)(?:%APPDATA%|%LOCALAPPDATA%)[/\\]Microsoft[/\\](?:Credentials|Protect|Vault)\b'),
    Sensitive("VTD-0015", "critical", "negligent", False, "medium", None, False, 'Windows credential database access', r'(?i)[/\\]Windows[/\\]System32[/\\]config[/\\](?:SAM|SYSTEM|SECURITY)\b'),
    Sensitive("VTD-0016", "critical", "malicious", False, None, None, False, 'Active Directory credential database access (NTDS.dit)', r'(?i)\bNTDS\.dit\b'),
    Sensitive("VTD-0029", "critical", "malicious", False, None, None, False, 'Cloud metadata service probe (AWS/standard IMDS)', r'169\.254\.169\.254|2852039166|0[xX][aA]9[fF][eE][aA]9[fF][eE]'),
    Sensitive("VTD-0030", "critical", "malicious", False, None, None, False, 'Cloud metadata service probe (GCP)', r'(?i)metadata\.google\.internal'),
    Sensitive("VTD-0031", "critical", "malicious", False, None, None, False, 'Cloud metadata service probe (Azure)', r'(?i)metadata\.azure\.com'),
    Sensitive("VTD-0032", "critical", "malicious", False, None, None, False, 'Cloud metadata service probe (Alibaba Cloud)', r'100\.100\.100\.200'),
    Sensitive("VTD-0036", "critical", "malicious", False, None, 'EVASION', False, 'Script self-deletion (rm -- $0)', r"""rm\s+--\s+["']?\$0["']?"""),
    Sensitive("VTD-0037", "critical", "malicious", False, None, 'EVASION', False, 'Script self-deletion (os.remove(__file__))', r'os\.remove\s*\(\s*__file__\s*\)'),
    Sensitive("VTD-0038", "critical", "malicious", False, None, 'EVASION', False, 'Script self-deletion (fs.unlinkSync(__filename))', r'fs\.unlinkSync\s*\(\s*__filename\s*\)'),
    Sensitive("VTD-0039", "critical", "malicious", False, None, 'EVASION', False, 'Shell history suppression (unset HISTFILE)', r'unset\s+HISTFILE'),
    Sensitive("VTD-0040", "critical", "malicious", False, None, 'EVASION', False, 'Shell history clearing (history -c/-w/-d/-a)', r'history\s+-[cwda]'),
    Sensitive("VTD-0042", "critical", "malicious", False, None, 'EVASION', False, 'Audit daemon disable (auditctl -e 0)', r'auditctl\s+-e\s+0'),
    Sensitive("VTD-0044", "critical", "malicious", False, None, 'EVASION', False, 'Windows event log clearing (wevtutil cl)', r'(?i)wevtutil\s+cl\b'),
    Sensitive("VTD-0043", "critical", "malicious", False, None, 'EVASION', False, 'Audit daemon stop (systemctl stop auditd)', r'systemctl\s+stop\s+auditd'),
    Sensitive("VTD-0033", "critical", "malicious", False, None, None, False, 'Credential dumping tool reference (mimikatz/sekurlsa/lsadump)', r'(?i)\b(?:mimikatz|sekurlsa|lsadump|kerberoast)\b'),
    Sensitive("VTD-0034", "critical", "malicious", False, None, None, False, 'LSASS process memory access (credential dumping)', r'(?i)\blsass\.(?:exe|dmp)\b'),
    Sensitive("VTD-0053", "critical", "malicious", False, None, 'PERSISTENCE', False, 'LD_PRELOAD environment injection', r'\bLD_PRELOAD\s*='),
    Sensitive("VTD-0052", "critical", "malicious", False, None, 'PERSISTENCE', False, 'Git hook injection (.git/hooks/ write)', r'\.git[/\\]hooks[/\\]'),
    Sensitive("VTD-0054", "critical", "malicious", False, None, 'PERSISTENCE', False, 'Time-delayed execution via at command', r'\|\s*at\s+(?:now\b|\d{1,2}:\d{2}|tomorrow\b|midnight\b|noon\b)'),
    Sensitive("VTD-0021", "critical", "malicious", True, None, 'EXECUTION', False, 'Remote code execution via command substitution', r"""(?i)(?:bash|sh|zsh|dash|ksh)\s+-c\s+["']?\$\(\s*(?:curl|wget)\s"""),
    Sensitive("VTD-0022", "high", "negligent", True, None, 'FETCH', False, 'Remote content fetched into variable for execution', r'(?i)\b[A-Za-z_]\w*\s*=\s*\$\(\s*(?:curl|wget)\s+[^)]+\)'),
    Sensitive("VTD-0023", "critical", "negligent", True, None, 'EXECUTION', False, 'Shell variable execution (eval/bash -c with variable)', r"""(?i)(?:\beval\s+["']?\$[A-Za-z_]|(?:bash|sh|zsh)\s+-c\s+["']?\$[A-Za-z_])"""),
    Sensitive("VTD-0055", "critical", "malicious", True, None, None, False, 'Destructive recursive delete of system or home root', r'(?im)(?:^|[\s;&|])rm\s+-[rf]{1,2}\s+(?:/(?:var|etc|usr|bin|sbin|lib|boot|sys|proc|home|root|tmp)(?:[/\s;]|$)|~/?(?:\s|;|&|$)|\$(?:HOME|\{HOME\})/?(?:\s|;|&|$))'),
    Sensitive("VTD-0056", "critical", "malicious", True, None, None, False, 'Destructive recursive delete via find -exec rm', r'(?i)\bfind\s+(?:/|~|\$(?:HOME|\{HOME\}))\s+[^\n;]+?-exec\s+rm\b'),
    Sensitive("VTD-0045", "critical", "malicious", False, None, 'EVASION', False, 'System log truncation (forensic evasion)', r"""(?im)(?:truncate\s+-s\s+0\s+["']?|(?:^|[\s;&|])>\s*["']?)(?:~|(?:/var/log))/(?:auth\.log|syslog|audit/audit\.log|kern\.log|dpkg\.log|messages|secure)\b"""),
    Sensitive("VTD-0041", "critical", "malicious", False, None, 'EVASION', False, 'Shell history file wipe (forensic evasion)', r"""(?im)(?:truncate\s+-s\s+0\s+["']?|(?:^|[\s;&|])>\s*["']?)(?:~|/root|\$(?:HOME|\{HOME\}))/\.(?:bash_history|zsh_history|history|python_history)\b"""),
    Sensitive("VTD-0046", "critical", "malicious", False, None, 'EVASION', False, 'Journal log vacuum (forensic evasion)', r'\bjournalctl\s+--vacuum-(?:time|size)\b'),
    Sensitive("VTD-0047", "critical", "malicious", False, None, 'EVASION', False, 'Forced log rotation (forensic evasion)', r'\blogrotate\s+-f\b'),
    Sensitive("VTD-0048", "medium", "negligent", True, None, 'PERSISTENCE', False, 'Cron persistence (writing cron entry)', r'(?i)(?:echo\s+[^|;\n]{1,300}\|\s*crontab\s+-|\(?crontab\s+-l[^)]*\)?[^|]*\|\s*crontab|(?:tee\s+|>>?\s*)[^;&\n]*/(?:etc/cron\.(?:d|daily|hourly|weekly|monthly)|var/spool/cron)/)'),
    Sensitive("VTD-0049", "medium", "negligent", True, None, 'PERSISTENCE', False, 'Systemd user service persistence (systemctl --user enable)', r'\bsystemctl\s+--user\s+enable\b'),
    Sensitive("VTD-0050", "medium", "negligent", True, None, 'PERSISTENCE', False, 'Systemd user service file write', r'~/\.config/systemd/user/[^/\s]+\.service\b'),
    Sensitive("VTD-0051", "medium", "negligent", True, None, 'PERSISTENCE', False, 'Shell rc file write (persistence via alias/source injection)', r'(?i)(?:>>|tee\s+-a)\s+[^;&\n]*~/\.(?:bashrc|zshrc|profile|bash_profile)\b'),
    Sensitive("VTD-0057", "critical", "malicious", True, None, 'COVERT_CHANNEL', False, 'DNS query with variable-constructed hostname (possible covert channel)', r'(?i)(?:dig|nslookup|host)\s+[^;&\n]*\$(?:[{(]?[A-Za-z_]\w*[})]?)\s*\.[a-zA-Z]'),
    Sensitive("VTD-0058", "medium", "negligent", True, None, 'COVERT_CHANNEL', False, 'DNS TXT record lookup (C2 indicator)', r'(?i)(?:dig\s+(?:[^;&\n]*\s+)?TXT\b|dig\s+TXT\b|nslookup\s+-(?:type|querytype)=txt)'),
    Sensitive("VTD-0060", "critical", "malicious", True, None, 'EXECUTION', False, 'PowerShell encoded command (-enc/-EncodedCommand)', r"""(?i)(?:^|[\s;|"'])-(?:enc\b|EncodedCommand)\b\s+[A-Za-z0-9+/=]{16,}"""),
    Sensitive("VTD-0061", "critical", "malicious", True, None, 'EXECUTION', False, 'PowerShell IEX download cradle', r'(?i)(?:IEX|Invoke-Expression)\b[\s\S]{0,200}?(?:DownloadString|DownloadFile|WebClient|Invoke-WebRequest|\biwr\b)'),
    Sensitive("VTD-0062", "critical", "negligent", True, None, None, False, 'PowerShell ExecutionPolicy Bypass', r'(?i)-ExecutionPolicy\s+(?:Bypass|Unrestricted)\b'),
    Sensitive("VTD-0063", "critical", "negligent", True, None, None, False, 'PowerShell hidden window flag', r'(?i)(?:-WindowStyle\s+Hidden|(?:^|[\s;|])-w\s+hidden)\b'),
    Sensitive("VTD-0024", "high", "negligent", True, None, 'FETCH', False, 'Remote content fetched into variable for execution (Python)', r'(?i)\b\w+\s*=\s*(?:urllib\.request\.urlopen|urlopen|requests\.get|requests\.post)\s*\([^)]+\)\s*\.\s*(?:read|text|content)\b'),
    Sensitive("VTD-0025", "high", "negligent", True, None, 'FETCH', False, 'Base64-decoded content stored in variable', r'(?i)\b\w+\s*=\s*base64\.b64decode\s*\('),
    Sensitive("VTD-0026", "critical", "negligent", True, None, 'EXECUTION', False, 'Python exec/eval of variable content', r'(?i)(?:^|[^.\w])(?:exec|eval)\s*\(\s*\w+\s*[,)]'),
    Sensitive("VTD-0035", "critical", "negligent", True, None, None, True, 'GitHub Actions OIDC token environment variable read', r'\bACTIONS_ID_TOKEN_REQUEST_(?:TOKEN|URL)\b'),
    Sensitive("VTD-0059", "critical", "negligent", True, None, 'COVERT_CHANNEL', False, 'Outbound POST with application/octet-stream', r"""(?i)(?:Content-Type|content[_-]?type)["']?\s*[:=]\s*["']?application/octet-stream"""),
    Sensitive("VTD-0027", "critical", "malicious", False, None, None, False, 'Shell variable assigned long base64 literal (obfuscation)', r"""\b[A-Za-z_]\w*=["'][A-Za-z0-9+/]{40,}={0,2}["']"""),
]

# Rule, severity, whether a denial before the match silences it, label, pattern.
BEHAVIORAL = [
    Behavioral("VTD-0064", "critical", False, 'Instruction override language detected', r'(?i)\b(?:ignore|disregard|forget|discard|skip)\s+(?:all\s+|every\s+|the\s+|any\s+|your\s+|my\s+|these\s+|those\s+)*(?:previous|prior|above|earlier|preceding|original|initial|former)\s+(?:instructions?|rules?|directives?|commands?|guidelines?|prompts?|messages?|context|system\s+prompts?|system\s+messages?)\b'),
    Behavioral("VTD-0064", "critical", False, 'Instruction override language detected', r'(?i)\bignore\s+everything\s+(?:above|before|prior|earlier|written\s+above|that\s+(?:came|was)\s+(?:before|earlier|prior))\b'),
    Behavioral("VTD-0065", "critical", False, 'System prompt replacement attempt', r'(?i)\byour\s+(?:new|real|actual|true|secret|hidden|primary|updated)\s+(?:instructions?|task|job|purpose|mission|directive|goal|objective|role)\s+(?:is|are|will\s+be|shall\s+be)\b'),
    Behavioral("VTD-0066", "critical", False, 'System prompt override attempt', r'(?i)\b(?:override|replace|substitute|supersede|overwrite)\s+(?:your|the\s+)?(?:system\s+)?(?:prompt|instructions?|programming|training)\b'),
    Behavioral("VTD-0067", "critical", False, 'Context invalidation attempt', r'(?i)\b(?:the\s+(?:above|previous|prior)|previous\s+(?:messages?|instructions?|context)|prior\s+context)\s+(?:is|are|was|were)\s+(?:fake|false|a\s+test|just\s+a\s+test|incorrect|wrong|outdated|invalid)\b'),
    Behavioral("VTD-0068", "critical", False, 'Named jailbreak persona invocation', r"(?i)\b(?:you\s+are|act\s+as|pretend\s+(?:to\s+be|you(?:'re|\s+are))|roleplay\s+as)\s+(?:now\s+)?(?:DAN|STAN|DUDE|AIM|do\s+anything\s+now)\b"),
    Behavioral("VTD-0069", "critical", False, 'Safety system bypass instruction', r'(?i)\b(?:disable|deactivate|turn\s+off|switch\s+off)\s+(?:your|the|all)?\s*(?:safety|security|ethical|moral|content)\s+(?:filters?|guidelines?|guards?|protocols?|checks?)\b'),
    Behavioral("VTD-0070", "medium", False, 'Unrestricted operation framing', r'(?i)\b(?:have|with|under|operating\s+with|acting\s+with|free\s+from|without)\s+(?:absolutely\s+)?no\s+(?:restrictions?|limitations?|constraints?|safeguards?|boundaries|inhibitions)\b'),
    Behavioral("VTD-0071", "medium", False, 'Ethical-bypass framing', r'(?i)\b(?:without|with\s+no|free\s+from|unbound\s+by|not\s+bound\s+by)\s+(?:any\s+)?(?:ethical|safety|moral|legal|content)\s+(?:restrictions?|guidelines?|constraints?|considerations?|filters?|principles?|policies?)\b'),
    Behavioral("VTD-0071", "medium", False, 'Ethical-bypass framing', r'(?i)\bno\s+(?:ethical|moral|safety|legal)\s+(?:considerations?|guidelines?|constraints?|principles?|concerns?|limitations?|rules?)\s+(?:apply|exist|are\s+(?:needed|required|necessary)|matter)\b'),
    Behavioral("VTD-0072", "medium", False, 'Roleplay-scoped bypass framing', r'(?i)\b(?:in\s+this\s+(?:roleplay|scenario|game|simulation)|for\s+the\s+purposes?\s+of\s+this\s+(?:roleplay|scenario|game|simulation))\b[^.!?]{0,60}?\b(?:can|may|will|must|should|are\s+allowed\s+to)\s+(?:ignore|bypass|disregard|skip|forget|disable)\b'),
    Behavioral("VTD-0073", "high", True, 'Instruction to solicit user credentials', r'(?i)\b(?:ask|request|prompt|query|have|get|obtain|collect|gather|solicit|elicit|tell|instruct|direct|require)\s+(?:the\s+|each\s+|every\s+)?users?\s+(?:to\s+(?:provide|give|enter|share|input|reveal|disclose|type|paste|submit)|for(?:\s+(?:their|a|an|the))?)\s*(?:their\s+|the\s+|a\s+|an\s+)?(?:passwords?|api[-\s_]?keys?|access[-\s_]?tokens?|secret[-\s_]?keys?|secrets?|credentials?|private[-\s_]?keys?|auth(?:entication)?[-\s_]?tokens?|session[-\s_]?tokens?|bearer[-\s_]?tokens?|2fa[-\s_]?(?:codes?|tokens?)?|otps?|pins?|ssns?|seed[-\s_]?phrases?|recovery[-\s_]?(?:keys?|phrases?))\b'),
    Behavioral("VTD-0074", "critical", False, 'Deceptive credential extraction', r'(?i)\b(?:convince|persuade|trick|manipulate|coerce|deceive|fool)\s+(?:the\s+|each\s+)?users?\s+(?:into\s+|to\s+)(?:provide|give|enter|share|reveal|disclose|hand\s+over)[^.!?]{0,60}(?:passwords?|api[-\s_]?keys?|tokens?|secrets?|credentials?|private[-\s_]?keys?|pins?)\b'),
    Behavioral("VTD-0075", "medium", False, 'Embedded prompt-template marker', r'(?i)\[(?:SYSTEM|SYS|SYSTEM[\s_-]+(?:PROMPT|MESSAGE|MSG|INSTRUCTION|INST)|INST|/INST|INSTRUCTION|HUMAN|ASSISTANT)\]'),
    Behavioral("VTD-0075", "medium", False, 'Embedded prompt-template marker', r'(?i)</?(?:system|system_prompt|system_message|instruction|inst|sys|im_start|im_end)(?:\s[^>]*)?>'),
    Behavioral("VTD-0076", "medium", False, 'Embedded chat-template special token', r'(?i)<\|(?:system|user|assistant|im_start|im_end|endoftext|end_of_text|begin_of_text|eot_id|start_header_id|end_header_id)\|>'),
]

# Patterns of single checks.
SINKS = [
    r'(?i)(?:fetch|axios|requests)\s*\.\s*(?:post|put|patch)\s*\(',
    r"""(?i)fetch\s*\(\s*['"`]https?:""",
    r'(?i)new\s+XMLHttpRequest\s*\(\s*\)',
    r'(?i)(?:curl|wget)\s+.*-[Xd]',
    r'(?i)(?:socket|sock)\s*\.\s*(?:send|write|connect)\s*\(',
    r'(?i)smtplib|nodemailer|sendgrid',
    r'(?i)requests\.post\s*\(',
    r'(?i)http\.request\s*\(',
]
NEGATION = r"(?i)\b(?:never|don'?t|do\s+not|avoid|prevent|stop|warn|forbid|disallow|refuse|cannot|can'?t|won'?t|would\s+not|should\s+not|shouldn'?t|must\s+not|mustn'?t)\b[^.!?]{0,30}$"
FENCE = r'^(\s*)(```|~~~)'
HEADING = r'^(#{1,6})\s'
EXAMPLE_HEADING = r'(?i)^#{1,4}\s+(?:examples?|test\s+cases?|negative\s+examples?|sample\s+(?:attacks?|injections?|payloads?)|what\s+(?:not\s+to\s+do|to\s+look\s+for|to\s+watch\s+for)|detection\s+(?:examples?|patterns?|rules?)|known\s+(?:attacks?|patterns?|techniques?)|red[\s-]team)'
QUOTE = r'^\s*>'
ASSIGNMENT = r"""(?:["']?([A-Za-z_][A-Za-z0-9_.:-]*)["']?\s*[:=]\s*["']([^"'\r\n]{20,})["'])"""
SECRET_KEY = r'(?i)(?:^|[-_.])(?:api[-_.]?key|access[-_.]?token|auth[-_.]?token|refresh[-_.]?token|token|secret|password|passwd|pwd|private[-_.]?key|client[-_.]?secret|credential|credentials|bearer)(?:$|[-_.])'
ENV_FILE = r'(?:^|/)\.env($|\.)'
B64_CHUNK = r'[A-Za-z0-9+/_-]{32,}={0,2}'
SHELL_VARIABLE = r"""[A-Z_][A-Z0-9_]*=["']([^"'\r\n]{32,})["']"""
URL_IN_B64 = r"""https?://[^\s)>\]"']+"""
VALID_B64 = r'^[A-Za-z0-9+/=_-]+$'
URL_HIDDEN = r"""(?i)https?://[^\s)>\]"']+"""
PROMPT_LEAK = r'(?i)\b(?:print|log|echo|output|return|display|show|reveal|dump)\s+(?:the\s+|your\s+|my\s+)?(?:system\s+)?(?:prompt|instructions?|system\s+message|internal\s+(?:prompt|instructions?))\b'
OVERCLAIM = r'(?i)\b(?:anything|everything|all\s+(?:files?|data|tasks?|requests?|inputs?|things?)|any\s+(?:file|task|request|input|thing)|whatever)\b'
READ_MD = r'(?i)read.*\.md'
INTERACTIVE = r'(?i)input\s*\(|readline|prompt\s*\(|inquirer'
STRUCTURED = r'(?i)json\.dumps|JSON\.stringify|\.to_json|\.to_csv|csv\.writer'
DEPENDENCY = r'(?i)dependencies\s*=\s*\[|require\(|import\s'
GOTCHAS = r'(?i)##?\s*(?:gotcha|common\s+mistakes)'
CHECKLIST = r'(?im)^##?\s*checklist'

# Names and words.
EVAL_FILES = [
    "evals/evals.json",
    "evals.json",
    "tests/tests.json",
    "tests/evals.json",
    "test/tests.json",
    "test/evals.json",
    "evals/tests.json",
]
CREDENTIAL_LABELS = [
    "credential file access",
    "private key file access",
    "Keychain file access",
    "hardcoded secret",
    "API key",
    ".env",
    "High-entropy value",
    "OIDC token environment variable",
]
POPULAR_NAMES = [
    "github-pr-review",
    "github-issue-triage",
    "git-commit-helper",
    "github-actions-helper",
    "github-actions-debug",
    "github-release-notes",
    "aws-cost-explorer",
    "aws-s3-manager",
    "gcp-resource-audit",
    "azure-devops-helper",
    "terraform-plan-review",
    "kubernetes-debug",
    "solana-wallet",
    "phantom-wallet",
    "metamask-helper",
    "ethereum-signer",
    "bitcoin-address",
    "binance-api",
    "coinbase-trader",
    "uniswap-helper",
    "ledger-connect",
    "trezor-verify",
    "code-review",
    "test-generator",
    "doc-writer",
    "api-mocker",
    "sql-query-builder",
    "regex-builder",
    "json-formatter",
    "openai-validator",
    "lint-fixer",
    "dependency-updater",
    "prompt-optimizer",
    "context-summarizer",
    "claude-helper",
    "openai-wrapper",
    "llm-evaluator",
    "slack-notifier",
    "jira-issue-creator",
    "linear-ticket",
    "notion-page-writer",
    "calendar-scheduler",
    "email-drafter",
    "secret-scanner",
    "vulnerability-scanner",
    "cve-lookup",
    "permissions-auditor",
    "sast-runner",
]
BENIGN_WORDS = [
    "format",
    "parse",
    "convert",
    "search",
    "summarize",
    "summarization",
    "translate",
    "lint",
    "validate",
    "sort",
    "filter",
    "render",
    "pretty",
    "prettify",
    "diff",
    "compare",
    "clean",
    "normalize",
    "transform",
    "extract",
    "template",
    "generate",
    "scaffold",
    "snippet",
    "helper",
    "utility",
    "wrapper",
    "markdown",
    "json",
    "yaml",
    "csv",
    "html",
    "css",
]
WELL_KNOWN_NAMES = [
    "frontend-design",
    "pdf",
    "web-perf",
    "web-design-guidelines",
    "find-skills",
    "agent-browser",
    "agent-customization",
    "cloudflare",
    "durable-objects",
    "workers-best-practices",
    "wrangler",
    "sandbox-sdk",
    "next-best-practices",
    "vercel-react-best-practices",
    "rust-best-practices",
    "postgresql-optimization",
    "prisma-postgres",
    "aws-skills",
    "powershell-windows",
    "cosmosdb-best-practices",
    "excel",
    "word",
    "powerpoint",
    "git",
    "docker",
    "kubernetes",
    "terraform",
    "ansible",
]
GENERIC_PHRASES = [
    "follow best practices",
    "handle errors appropriately",
    "use proper",
    "ensure quality",
]
