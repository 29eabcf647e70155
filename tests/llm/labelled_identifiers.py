"""Identifiers and random strings that no model is trained on, labelled by hand or by how they came about."""

from __future__ import annotations

import base64
import hashlib

ORDINARY = """usr/lib/x86_64-linux-gnu/libQt5Core
x86_64-unknown-linux-gnu aarch64-apple-darwin armv7-unknown-linux-gnueabihf wasm32-unknown-unknown
wss/v2/ws/btcusdt/kline_1m /dp/B08N5WRWNW/ref/sr_1_3 watch/dQw4w9WgXcQ/playlist
Przedsiebiorstwo-Wielobranzowe-Zrzeszenie abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789012345
3f2504e0-4f89-11d3-9a0c-0305e82c3301 550E8400-E29B-41D4-A716-446655440000 9b2f7c1e-8a44-4d0b-b6d5-2f1c9e7a3d10
Donaudampfschifffahrtsgesellschaft Geschwindigkeitsbegrenzung Rindfleischetikettierung Krankenversicherungskarte
anticonstitutionnellement desoxyribonucleique internationalisation electroencephalogram otorrinolaringologo
desafortunadamente responsabilidades constitucionalidad vereinheitlichung Straßenverkehrsordnung
node_modules/webpack/lib/optimize/ModuleConcatenationPlugin src/main/java/org/apache/hadoop/hdfs/DistributedFileSystem
org/springframework/boot/autoconfigure/jdbc/DataSourceAutoConfiguration AbstractSingletonProxyFactoryBean
InternalFrameInternalFrameTitlePaneInternalFrameTitlePaneMaximizeButtonWindowNotFocusedState
kubernetes-dashboard-certs-7d9c prometheus-node-exporter-daemonset docker-entrypoint-initdb getElementsByClassName
addEventListener XMLHttpRequestEventTarget requestAnimationFrame setUncaughtExceptionHandler
MAX_UNSIGNED_LONG_VALUE ERR_CONNECTION_TIMED_OUT_42 SQLITE_CONSTRAINT_FOREIGNKEY HTTP_STATUS_SERVICE_UNAVAILABLE
2024-03-17T08-15-30-backup 20240317-081530-nightly-build release/2024-11-05/changelog IMG_20190704_153012 DSC_0000123456
utf8mb4_unicode_520_ci en_US-hunspell-all zh-Hans-CN-u-nu-hanidec ISO-8859-15-euro-sign EBCDIC-CP-HE
-----------------------------
____________________ ////////////////////// AAAAAAAAAAAAAAAAAAAA 00000000000000000000 +1-800-555-0199-4432
/questions/11227809/why-is-processing-a-sorted-array-faster /wiki/Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch
/r/programming/comments/8vj3k2/how_we_scaled /watch/highlights/season-3-episode-12 /gp/help/customer/display
/en-us/dotnet/api/system/collections/generic/dictionary-2 com/google/common/collect/ImmutableSortedMultiset
Microsoft-Windows-Kernel-Processor-Power/Diagnostic HKEY_LOCAL_MACHINE/SOFTWARE/Classes/CLSID
tyrannosaurus-rex-skeleton floccinaucinihilipilification supercalifragilistic pneumonoultramicroscopic Massachusetts-Avenue-NW
jquery-ui-1-13-2-min bootstrap-4-6-0-dist/css/bootstrap-grid tensorflow-gpu-2-11-0-cp310-manylinux2014
rhel-8-for-x86_64-baseos-rpms linux-image-5-15-0-91-generic ubuntu-22-04-live-server-amd64 openjdk-17-jre-headless
gemeinschaftliche wissenschaftlichen Bundesverfassungsgericht gesellschaftlichen extraordinairement institutionnalisation""".split()


def _digest(i: int) -> bytes:
    return hashlib.sha256(f"sample {i}".encode()).digest()


def random_strings() -> list[str]:
    """Keys as services issue them: base 64 in both alphabets, base 32, base 58, capital hexadecimal, 16 characters and more."""
    base58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    out = []
    for i in range(40):
        d = _digest(i)
        n = 16 + i % 25
        out += [base64.b64encode(d).decode()[:n], base64.urlsafe_b64encode(d).decode()[:n], base64.b32encode(d).decode()[:n], "".join(base58[x % 58] for x in d)[:n], d.hex().upper()[:n]]
    return out
