"""Names of numbered values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of IP protocols 0..137, in order.
PROTOCOLS = (
    "0 ICMP IGMP GGP IPIP ST TCP CBT EGP IGP BBN NVPII PUP ARGUS ENCOM XNET CHAOS UDP MUX DCN HMP PRM XNS Trnk1 Trnk2 Leaf1 Leaf2 "
    "RDP IRTP ISO-4 NETBK MFESP MEINP DCCP 3PC IDPR XTP DDP IDPR TP++ IL IPv6 SDRP Rte6 Frag6 IDRP RSVP GRE MHRP BNA ESP AH INLSP "
    "SWIPE NARP MOBIL TLSP SKIP ICMP6 NOHE6 OPTS6 HOST CFTP NET SATNT KLAN RVD IPPC FS SATM VISA IPCV CPNX CPHB WSN PVP BSATM SUNND "
    "WBMON WBEXP ISOIP VMTP SVMTP VINES TTP NSIGP DGP TCF EIGRP OSPF S-RPC LARP MTP AX.25 OS MICP SCCSP ETHIP ENCAP 99 GMTP IFMP PNNI "
    "PIM ARIS SCPS QNX A/N IPcmp SNP CpqPP IPXIP VRRP PGM 0hop L2TP DDX IATP STP SRP UTI SMP SM PTP ISIS4 FIRE CRTP CRUDP 128 IPLT "
    "SPS PIPE SCTP FC 134 MHEAD UDP-L MPLS"
).split()
# Forwarding status.
FORWARDING = {
    0: "Ukwn", 1: "Forw", 2: "Frag", 16: "Drop", 17: "DaclD", 18: "Daclp", 19: "Noroute", 20: "Dadj", 21: "Dfrag", 22: "Dbadh", 23: "Dbadtlen", 24: "Dbadhlen",
    25: "DbadTTL", 26: "Dpolicy", 27: "Dwred", 28: "Drpf", 29: "Dforus", 30: "DbadOf", 31: "Dhw", 128: "Term", 129: "Tadj", 130: "TincAdj", 131: "Tforus",
}
# Firewall events, extended events (first name is printed), NAT events (RFC 8158), packet filter actions and reasons.
FW_EVENTS = {0: "IGNORE", 1: "CREATE", 2: "DELETE", 3: "DENIED", 4: "ALERT", 5: "UPDATE"}
FW_XEVENTS = {0: ["IGNORE"], 1001: ["I-ACL", "ingress"], 1002: ["E-ACL", "egress"], 1003: ["DENY", "access", "interface"], 1004: ["NOSYN"]}
NAT_EVENTS = "INVALID ADD DELETE EXHAUST ADD44 DEL44 ADD64 DEL64 ADD44BIB DEL44BIB ADD64BIB DEL64BIB PEXHAUST QUOTAEXH ADDADDR DELADDR ADDPBLK DELPBLK THRESHLD".split()
PF_ACTIONS = "pass block scrub noscrub nat nonat binat nobinat rdr nordr synblock defer match divert rt afrt".split()
PF_REASONS = "match bad-offset fragment short normalize memory bad-timestamp congestion ip-option proto-cksum state-mismatch state-insert state-limit src-limit synproxy translate no-route".split()
TCP_FLAGS = "FSRPAUEC"  # from the lowest bit
BIFLOW = ["", "initiator", "reverseInitiator", "perimeter"]
END_REASONS = ["", "idle timeout", "active timeout", "end of Flow detected", "forced end", "lack of resources"]


def _number(names, text: str) -> int | None:
    for i, n in names:
        if n.lower() == text.lower():
            return i
    return None


def protocol_number(name: str) -> int | None:
    """By name or its unambiguous beginning, whatever the case; the first in order wins."""
    if len(name) >= 6:
        return None
    for i, n in enumerate(PROTOCOLS):
        if n.lower().startswith(name.lower()):
            return i
    return None


def forwarding_number(name: str) -> int | None:
    return _number(FORWARDING.items(), name)


def fw_event_number(name: str) -> int | None:
    return _number(FW_EVENTS.items(), name)


def fw_xevent_number(name: str) -> int | None:
    return _number(((i, n) for i, ns in FW_XEVENTS.items() for n in ns), name)


def nat_event_number(name: str) -> int | None:
    return _number(enumerate(NAT_EVENTS), name)


def pf_action_number(name: str) -> int | None:
    return _number(enumerate(PF_ACTIONS), name)


def pf_reason_number(name: str) -> int | None:
    return _number(enumerate(PF_REASONS), name)


def name_of(value: Column, names, otherwise: Column | None = None) -> Column:
    """Name of a number by a literal map; unknown numbers as digits or by `otherwise`."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    m = F.create_map(*[F.lit(x) for k, v in pairs for x in (int(k), v)])
    return F.coalesce(F.try_element_at(m, value.cast("int")), otherwise if otherwise is not None else value.cast("string"))


def protocol_name(proto: Column) -> Column:
    return name_of(proto, PROTOCOLS)


def flags_text(flags: Column) -> Column:
    """Eight characters CEUAPRSF, a dot for each unset flag."""
    return F.when(flags.isNotNull(), F.concat(*[F.when(flags.bitwiseAND(1 << i) != 0, F.lit(TCP_FLAGS[i])).otherwise(F.lit(".")) for i in range(7, -1, -1)]))
