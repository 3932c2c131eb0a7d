"""Names of all descriptor columns, by family, and the named column sets.

A name is followed by the smallest named set that has it: ``:m`` minimal,
``:s`` small, ``:d`` default; without a mark it is in the full set alone. A
name after ``-`` is computed but not emitted. The order is the columns' order.
"""

from __future__ import annotations

from ..functions.patterns import ESTATE, FRAGMENTS

#: Fixed values.
_BLOCKS = """
BalabanJ:m -BalabanJ_mordred chi0n:s chi1n:s chi2n:s chi3n:s chi4n:d chi5n:d chi6n:d chi7n:d chi0v:s chi1v:s -chi2v -chi3v -chi4v chi5v:d chi6v:d
chi7v:d path1:s path2:s path3:s path4:s path5:s path6:s path7:s path_total:s path_ratio:m chi_nv_ratio:s C3:s C4:s C5:s C6:s C7:s C8:s C_total:s
C_maxlen:s C_minlen:s pa3_max:s -pa4_max pa5_max:s pa6_max:s -pa7_max -pa8_max pa3_mean:s -pa4_mean pa5_mean:s pa6_mean:m -pa7_mean -pa8_mean
pa_all_max:s pa_all_mean:m pa_all_std:m frac_in_cycle:m n_multi_cycle:s C5_het:s C6_het:s C5_arom:s C6_arom:s C6_carbo:s n_sys:s conj_atoms:m
conj_frac:m sys_max:m sys_max_frac:m sys_2nd:s sys_mean:m -sysbin0 sysbin1:s sysbin2:s sysbin3:s sysbin4:s sysbin5:s diam_max:s linearity:m diam_sum:m
branch_pts:s branch_frac:m extra_arom:m extra_arom_frac:m extra_arom_max:m het_in_max:m het_frac_max:m sys_max_rings:s S_sum:s S_absum:s S_sum_norm:s
S_central:s S_mass:s SATS1:s SATS2:s SATS3:d SATS4:d SATS5:d SATS6:d SATS_far:s T_sum:s T_absum:s -n_EZ_any TATS1:s TATS2:s TATS3:d TATS4:d XATS1:s
XATS2:s XATS3:d XATS4:d RATSC0_m:s -RATSC0_e -RATSC0_p -RATSC0_v -RPAIR0 RATSC1_m:m RATSC1_e:m RATSC1_p:m RATSC1_v:m RPAIR1:m RATSC2_m:m RATSC2_e:m
RATSC2_p:m RATSC2_v:m RPAIR2:m RATSC3_m:d RATSC3_e:d RATSC3_p:d RATSC3_v:d RPAIR3:d RATSC4_m:d RATSC4_e:d RATSC4_p:d RATSC4_v:d RPAIR4:d Kf:s Kf_n:m
Kf_norm:m Cyclicity:m Cyclicity_n:m DeltaMax:m DeltaMean:m RW2_mean:m RW2_std:m RW2_max:s RW2_q90:s RW3_mean:s RW3_std:s RW3_max:s RW3_q90:s
RW4_mean:s RW4_std:s RW4_max:m RW4_q90:s RW6_mean:d RW6_std:d RW6_max:d RW6_q90:d RW8_mean:d RW8_std:d RW8_max:d RW8_q90:d RW12_mean:d RW12_std:d
RW12_max:d RW12_q90:d RW16_mean:d RW16_std:d RW16_max:d RW16_q90:d Kappa1:s Kappa2:m Kappa3:s HallKierAlpha:m BCUT2D_MWHI:m BCUT2D_MWLOW:m
BCUT2D_CHGHI:m BCUT2D_CHGLO:m BCUT2D_LOGPHI:m BCUT2D_LOGPLOW:m BCUT2D_MRHI:m BCUT2D_MRLOW:m
"""
#: Fixed values.
_VSA = """
SlogP_VSA1:d SlogP_VSA2:d SlogP_VSA3:d SlogP_VSA4:d SlogP_VSA5:d SlogP_VSA6:d SlogP_VSA7:d SlogP_VSA8:d -SlogP_VSA9 SlogP_VSA10:d SlogP_VSA11:d
SlogP_VSA12:d SMR_VSA1:d SMR_VSA2:d SMR_VSA3:d SMR_VSA4:d SMR_VSA5:d SMR_VSA6:d SMR_VSA7:d -SMR_VSA8 SMR_VSA9:d SMR_VSA10:d PEOE_VSA1:m PEOE_VSA2:m
PEOE_VSA3:m PEOE_VSA4:m PEOE_VSA5:m PEOE_VSA6:m PEOE_VSA7:m PEOE_VSA8:m PEOE_VSA9:m PEOE_VSA10:m PEOE_VSA11:m PEOE_VSA12:m PEOE_VSA13:s PEOE_VSA14:m
EState_VSA1:d EState_VSA2:d EState_VSA3:d EState_VSA4:d EState_VSA5:d EState_VSA6:d EState_VSA7:d EState_VSA8:d EState_VSA9:d EState_VSA10:d
EState_VSA11:d VSA_EState1:d VSA_EState2:d VSA_EState3:d VSA_EState4:d VSA_EState5:d VSA_EState6:d VSA_EState7:d VSA_EState8:d VSA_EState9:d
VSA_EState10:d -MolLogP MolMR:m TPSA:m TopoPSA:m LabuteASA:s MaxEStateIndex:m MinEStateIndex:m -MaxAbsEStateIndex MinAbsEStateIndex:s
"""
#: Fixed values.
_RINGCOUNT = """
-n3Ring -n4Ring n5Ring:m n6Ring:m n7Ring:s -nG12Ring n3HRing:s n4HRing:s n5HRing:m n6HRing:m n7HRing:s naRing:m -n5aRing -n6aRing naHRing:m n6aHRing
nARing n5ARing:m n6ARing:m nAHRing:m n5AHRing n6AHRing:m nFRing:s n7FRing:s n8FRing:d n9FRing:d n10FRing:d n11FRing:d n12FRing:d nG12FRing:m nFHRing:m
n9FHRing:d n10FHRing:d nG12FHRing:m nFaRing n8FaRing n9FaRing:d n10FaRing:d nG12FaRing nFaHRing n10FaHRing nG12FaHRing nFARing:s n8FARing n9FARing
n10FARing nG12FARing:s nFAHRing:m n8FAHRing n9FAHRing n10FAHRing nG12FAHRing:m
"""
#: Fixed values.
_PATHCOUNT = """
MPC4 MPC6 MPC9 piPC1 piPC2 piPC3 piPC4 piPC5 piPC6 piPC8 piPC10
"""
#: Fixed values.
_TOPOCHARGE = """
GGI1:s GGI2:s GGI3:m GGI4:s GGI5:d GGI6:d GGI7:d GGI8:d GGI9:d GGI10:d JGI1:m JGI2:m JGI3:m JGI4:m JGI5:d JGI6:d JGI7:d JGI8:d JGI9:d JGI10:d JGT10:m
"""
#: Fixed values.
_INFOCONTENT = """
IC0:m IC1:m IC2:m IC3:d IC4:d IC5:d -BIC0 -BIC1 BIC2:s BIC3:d BIC4:d BIC5:d MIC0:s MIC1:s MIC2:s MIC3:d MIC4:d -MIC5 ZMIC0:s ZMIC1:m ZMIC2:m ZMIC3:d
ZMIC4:d ZMIC5:d AvgIpc:m
"""
#: Fixed values.
_CHI = """
Xch-4d:d Xch-5d:d Xch-6d:d Xch-7d:d Xch-5dv:d Xch-6dv:d Xch-7dv:d Xc-3d:m Xc-4d:d Xc-5d:d Xc-6d:d Xc-3dv:s Xc-4dv:d Xc-5dv:d Xpc-4d:d Xpc-5d:d
Xpc-4dv:d Xpc-5dv:d Xpc-6dv:d Xp-2d:s Xp-4d:d Xp-5d:d Xp-6d:d AXp-1d:m AXp-2d:s AXp-3d:s AXp-4d:m AXp-5d:m AXp-6d:m AXp-7d:m Xp-5dv:d Xp-6dv:d
AXp-0dv:s AXp-1dv:s AXp-2dv:s AXp-3dv:s AXp-4dv:s AXp-5dv:s AXp-6dv:m AXp-7dv:m
"""
#: Fixed values.
_TOPOMISC = """
MWC03 MWC05 -MWC08 SRW05 SRW07 TSRW10:m Sp:d MZ:m Mv:m Mp:m Diameter:m TopoShapeIndex:s WPath:m WPol:s -ABCGG
"""
#: Fixed values.
_CONSTIT = """
C1SP1:s C2SP1:s C1SP2:m C2SP2:m C3SP2:m C1SP3:m C2SP3:m C3SP3:s C4SP3:s nH:m -nB nC:m nN nO:m nS:s nCl:s nBr:s nBondsS:m nBondsD:m nBondsT -nBondsA
nBondsM nBondsKD:s Kier1:m Kier2:m Kier3:m MDEC-22:m MDEC-23:m MDEC-33:m RNCG:m RPCG:m Lipinski:s GhoseFilter:s nAcid:s nBase:m Vabc:m RotRatio:m
bpol:m FilterItLogS:m fMF:m fragCpx:m SPS:m
"""
#: Fixed values.
_ALIAS = """
SLogP:m
"""
#: Fixed values.
_RDKCORE = """
RingCount:s NumAromaticRings:s NumAliphaticRings NumSaturatedRings:m NumAromaticCarbocycles:s NumAromaticHeterocycles:m NumAliphaticCarbocycles:s
NumAliphaticHeterocycles:m NumSaturatedCarbocycles:s NumSaturatedHeterocycles:m NumHeterocycles:m NumBridgeheadAtoms:s NumSpiroAtoms:s
HeavyAtomMolWt:m FractionCSP3:m Phi:m FpDensityMorgan1:m FpDensityMorgan2:m FpDensityMorgan3:m NumAtomStereoCenters:m
NumUnspecifiedAtomStereoCenters:m
"""
#: Fixed values.
_COUNTS = """
nAromAtom:m nAromBond nAtom:m nHeavyAtom:m nP:m nF:m nI:s nBonds:m nBondsKS:m n8Ring:d n12Ring:d n8HRing:d n12HRing:d n7aRing n7ARing:m n7AHRing
nG12AHRing:m n5FRing n6FRing:s n5FHRing n6FHRing n7FHRing:m n8FHRing:d n11FHRing:d n12FHRing:d n12FaRing:d n11FARing n12FARing:d n11FAHRing n12FAHRing
nRot:m
"""
#: Fixed values.
_ESTATE_EXT = """
SZ:s MAXsCH3:m MAXssCH2:m MAXaaCH:m MAXsssCH:m MAXdssC:m MAXaasC:m MAXssNH:m MAXdO:m MINsCH3:m MINssCH2:m MINaaCH:m MINsssCH:m MINdssC:m MINaasC:m
MINssNH:m MINdO:m SRW04 SRW06 SRW08 SRW09 SRW10
"""
#: Fixed values.
_ETA = """
ETA_alpha ETA_shape_p ETA_shape_y ETA_shape_x ETA_beta ETA_beta_s ETA_beta_ns ETA_beta_ns_d ETA_eta ETA_eta_L ETA_eta_R ETA_eta_F ETA_eta_FL ETA_eta_B
ETA_eta_BR ETA_dAlpha_A ETA_dAlpha_B ETA_epsilon_1 ETA_epsilon_2 ETA_epsilon_3 ETA_epsilon_4 ETA_epsilon_5 ETA_dEpsilon_A ETA_dEpsilon_B
ETA_dEpsilon_C ETA_dEpsilon_D ETA_dBeta ETA_psi_1 ETA_dPsi_B
"""
#: Fixed values.
_SPECTRAL = """
SpAbs_A SpMax_A SpDiam_A SpMAD_A BCUTc-1h:s BCUTc-1l:m BCUTdv-1h:m BCUTdv-1l:s BCUTd-1h:m BCUTd-1l:m BCUTs-1h:m BCUTs-1l:m BCUTZ-1h:m BCUTZ-1l:m
BCUTv-1h:m BCUTv-1l:m BCUTse-1h BCUTse-1l BCUTpe-1l:s BCUTare-1l BCUTp-1h BCUTp-1l BCUTi-1h BCUTi-1l SpAbs_DzZ SpDiam_DzZ SpMAD_DzZ SM1_DzZ SM1_Dzv
SM1_Dzse SM1_Dzare SM1_Dzp SM1_Dzi SpAbs_D SpDiam_D SpMAD_D
"""
#: Fixed values.
_MISC = """
MinPartialCharge:m MinAbsPartialCharge:m MaxAbsPartialCharge:m ExactMolWt:s fr_lactam:d fr_benzodiazepine:d fr_barbitur:d fr_azo:d fr_nitro_arom:d
fr_phenol_noOrthoHbond:s fr_phos_ester:d Chi0:s HybRatio:s Xch-3d:s Xch-3dv:s Xch-4dv:d Xc-6dv:d Xpc-6d:d Xp-1d:s Xp-3d:s Xp-7d:d AXp-0d:m Xp-2dv:s
Xp-3dv:m Xp-4dv:d Xp-7dv:d Sv:d ECIndex:s AETA_alpha AETA_beta AETA_beta_s AETA_beta_ns AETA_beta_ns_d AETA_eta AETA_eta_L AETA_eta_R AETA_eta_RL
AETA_eta_F AETA_eta_FL AETA_eta_B AETA_eta_BR AETA_dBeta VMcGowan:s MDEC-11:m MDEC-12:m MDEC-13:m MDEO-11:m MDEN-22:m MPC5 MPC7 MPC8 MPC10 TMPC10:s
piPC7 piPC9 TpiPC10:m Radius:s VAdjMat:s MWC02 MWC04 MWC07 MWC09 TMWC10:s mZagreb1:m mZagreb2:s NumValenceElectrons:s MaxPartialCharge:m
"""
#: The atom types whose count and whose sum are emitted.
_ESTATE_COUNTS = "sCH3 dCH2 ssCH2 dsCH aaCH sssCH dssC aasC aaaC ssssC sNH2 ssNH2 dNH ssNH dsN aaN sssN aasN ssssN sOH dO ssO aaO dsssP dS ssS aaS ddssS sCl sBr sI"
_ESTATE_SUMS = "sCH3 ssCH2 aaCH sssCH dssC aasC aaaC ssssC ssNH aaNH aaN sssN aasN sOH dO ssO sF ddssS sCl"
#: Fragments by the smallest set that has them; those not named are in default.
_FRAG_MINIMAL = """
fr_C_O fr_C_O_noCOO fr_Ar_OH fr_ester fr_Al_COO fr_COO2 fr_ketone fr_ether fr_phenol fr_NH2 fr_NH1 fr_NH0 fr_aniline fr_alkyl_halide fr_pyridine
fr_unbrch_alkane fr_Al_OH_noTert fr_para_hydroxylation fr_allylic_oxid fr_Ndealkylation2 fr_ketone_Topliss fr_ArN NumHDonors NumHAcceptors NOCount
NumHeteroatoms NumAmideBonds NHOHCount
"""
_FRAG_SMALL = """
fr_C_S fr_urea fr_imidazole fr_piperzine fr_epoxide fr_benzene fr_Ndealkylation1
"""
_FRAG_FULL = """
fr_Ar_N fr_halogen fr_bicyclic HeavyAtomCount
"""

WEIGHTS = "c d dv i p v se pe are Z m s".split()
VARIANTS = "ATS AATS ATSC AATSC MATS GATS".split()
LAGS = range(9)
#: The lags of each variant that are emitted, by weight.
_AUTOCORR = """
ATS   012345678 012345678 012345678 012       012345678 012345678 012345678 -         0        012345678 12345678 012345678
AATS  012345678 012345678 012345678 012345678 012345678 012345678 012345678 012345678 3678     012345678 8        012345678
ATSC  -         012345678 012345678 012345678 012345678 012345678 012345678 012345678 01345678 012345678 7        012345678
AATSC -         012345678 012345678 012345678 02345678  02345678  012345678 02345678  0345678  012345678 -        012345678
MATS  12345678  12345678  123478    134678    134678    13        12345678  12345678  12345678 12345678  -        12345678
GATS  12345678  12345678  12345678  12345678  12345678  12345678  12345678  12345678  1345678  12345678  68       12345678
"""
#: Families in the order of their columns.
FAMILIES = "blocks vsa estate ringcount pathcount topocharge infocontent autocorr frag chi topomisc constit alias rdkcore counts estate_ext eta spectral misc".split()
LEVELS = {"": "full", ":d": "default", ":s": "small", ":m": "minimal"}


def _parsed(text: str) -> list[tuple[str, bool, str]]:
    """(name, emitted, smallest set) of each name of a family."""
    out = []
    for word in text.split():
        name, colon, mark = word.partition(":")
        out.append((name.removeprefix("-") if name[0] == "-" else name, word[0] != "-", LEVELS[colon + mark]))
    return out


def _raw() -> dict[str, list[tuple[str, bool, str]]]:
    counts, sums = _ESTATE_COUNTS.split(), _ESTATE_SUMS.split()
    estate = [("N" + t, t in counts, "minimal") for t, _ in ESTATE] + [("S" + t, t in sums, "default") for t, _ in ESTATE]
    level = {n: k for k, text in (("minimal", _FRAG_MINIMAL), ("small", _FRAG_SMALL), ("full", _FRAG_FULL)) for n in text.split()}
    frag = [(n, n != "NumRotatableBonds", level.get(n, "default")) for n in [*(n for n, _ in FRAGMENTS), "NHOHCount", "HeavyAtomCount"]]
    lags = {(row.split()[0], w): cell for row in _AUTOCORR.split("\n") if row for w, cell in zip(WEIGHTS, row.split()[1:])}
    auto = [(f"{v}{k}{w}", str(k) in lags[v, w], "full") for v in VARIANTS for k in LAGS for w in WEIGHTS]
    made = {"estate": estate, "frag": frag, "autocorr": auto}
    return {f: made.get(f) or _parsed(globals()[f"_{f.upper()}"]) for f in FAMILIES}


RAW = _raw()
FAMILY_COLUMNS = {f: [n for n, emitted, _ in cols if emitted] for f, cols in RAW.items()}
#: All emitted columns; ``qed`` is last and in no set.
ALL_COLUMNS = (*(n for cols in FAMILY_COLUMNS.values() for n in cols), "qed")
FAMILY_OF = {n: f for f, cols in RAW.items() for n, _, _ in cols} | {"qed": "qed"}
OPTIONAL_COLUMNS = ("qed", "AvgIpc")
#: Columns of this engine's own: no other descriptor library has them.
ADDITIONAL = tuple(n for n in FAMILY_COLUMNS["blocks"] if n not in ("BalabanJ", *(f"chi{k}{v}" for k in range(5) for v in "nv")) and not n.startswith(("Kappa", "HallKier", "BCUT"))) + tuple(f"{v}{k}c" for v in ("ATS", "AATS") for k in LAGS)


def family_offsets() -> dict[str, tuple[int, int]]:
    """Half-open spans of the families over the emitted columns."""
    out, at = {}, 0
    for f, cols in FAMILY_COLUMNS.items():
        out[f] = (at, at + len(cols))
        at += len(cols)
    return out


FAMILY_OFFSETS = family_offsets()
_ORDER = ["minimal", "small", "default", "full"]


def _set(name: str) -> tuple[str, ...]:
    reach = _ORDER[: _ORDER.index(name) + 1]
    cols = [n for col in RAW.values() for n, emitted, least in col if emitted and least in reach]
    return tuple(cols if name == "full" else sorted(cols))


COLUMN_SETS = {name: _set(name) for name in _ORDER}
COLUMN_SETS["full_no_new"] = tuple(n for n in COLUMN_SETS["full"] if n not in ADDITIONAL)
#: Short names and the versions they stand for.
VERSIONS = {"default": "default-v2", "small": "small-v1", "minimal": "minimal-v3"}
COLUMN_SETS |= {"default-v2": COLUMN_SETS["default"], "minimal-v2": COLUMN_SETS["default"], "small-v1": COLUMN_SETS["small"], "default-v1": COLUMN_SETS["small"], "minimal-v3": COLUMN_SETS["minimal"]}
WITHDRAWN = ("minimal-v1",)
