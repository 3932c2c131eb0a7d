"""Substructure patterns as data. All are fixed values that results depend on, in their order."""

#: Counted fragments, name and pattern.
_FRAGMENTS = """
fr_C_O [CX3]=[OX1]
fr_C_O_noCOO [C!$(C-[OH])]=O
fr_Al_OH [C!$(C=O)]-[OH]
fr_Ar_OH c[OH1]
fr_methoxy [OX2](-[#6])-[CH3]
fr_oxime [CX3]=[NX2]-[OX2]
fr_ester [#6][CX3](=O)[OX2H0][#6]
fr_Al_COO C-C(=O)[O;H1,-]
fr_Ar_COO c-C(=O)[O;H1,-]
fr_COO2 [CX3](=O)[OX1H0-,OX2H1]
fr_ketone [#6][CX3](=O)[#6]
fr_ether [OD2]([#6])[#6]
fr_phenol [OX2H]-c1ccccc1
fr_aldehyde [CX3H1](=O)[#6]
fr_quatN [$([NX4+]),$([NX4]=*)]
fr_NH2 [NH2,nH2]
fr_NH1 [NH1,nH1]
fr_NH0 [NH0,nH0]
fr_Ar_N n
fr_aniline c-[NX3;!$(N=*)]
fr_Imine [Nv3](=C)-[#6]
fr_nitrile [NX1]#[CX2]
fr_hdrzine [NX3]-[NX3]
fr_hdrzone C=N-[NX3]
fr_N_O [N!$(N=O)](-O)-C
fr_nitro [$([NX3](=O)=O),$([NX3+](=O)[O-])][!#8]
fr_azide [$(*-[NX2-]-[NX2+]#[NX1]),$(*-[NX2]=[NX2+]=[NX1-])]
fr_priamide C(=O)-[NH2]
fr_amidine C(=N)(-N)-[!#7]
fr_guanido C(=N)(N)N
fr_Nhpyrrole [nH]
fr_imide N(-C(=O))-C=O
fr_halogen [#9,#17,#35,#53]
fr_alkyl_halide [CX4]-[Cl,Br,I,F]
fr_sulfide [SX2](-[#6])-C
fr_SH [SH]
fr_C_S C=[SX1]
fr_sulfone S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])(-[#6])-[#6]
fr_sulfonamd N-S(=,-[OX1;+0,-1])(=,-[OX1;+0,-1])-[#6]
fr_urea C(=O)(-N)-N
fr_term_acetylene C#[CH]
fr_imidazole n1cncc1
fr_furan o1cccc1
fr_thiophene s1cccc1
fr_thiazole c1scnc1
fr_oxazole c1ocnc1
fr_pyridine n1ccccc1
fr_piperdine N1CCCCC1
fr_piperzine N1CCNCC1
fr_morpholine O1CCNCC1
fr_lactone [C&R1](=O)[O&R1][C&R1]
fr_tetrazole c1nnnn1
fr_epoxide O1CC1
fr_unbrch_alkane [CR0;D2,D1][CR0;D2][CR0;D2][CR0;D2,D1]
fr_bicyclic [R2][R2]
fr_benzene c1ccccc1
fr_phos_acid [$(P(=[OX1])([$([OX2H]),$([OX1-]),$([OX2]P)])([$([OX2H]),$([OX1-]),$([OX2]P)])[$([OX2H]),$([OX1-]),$([OX2]P)]),$([P+]([OX1-])([$([OX2H]),$([OX1-]),$([OX2]P)])([$([OX2H]),$([OX1-]),$([OX2]P)])[$([OX2H]),$([OX1-]),$([OX2]P)])]
fr_nitro_arom_nonortho [$(c1(-[$([NX3](=O)=O),$([NX3+](=O)[O-])])ccccc1);!$(cc-!:*)]
fr_Al_OH_noTert [$(C-[OX2H]);!$([CX3](-[OX2H])=[OX1]);!$([CD4]-[OX2H])]
fr_para_hydroxylation [$([cH]1[cH]cc(c[cH]1)~[$([#8,$([#8]~[H,c,C])])]),$([cH]1[cH]cc(c[cH]1)~[$([#7X3,$([#7](~[H,c,C])~[H,c,C])])]),$([cH]1[cH]cc(c[cH]1)-!:[$([NX3H,$(NC(=O)[H,c,C])])])]
fr_allylic_oxid [$(C=C-C);!$(C=C-C-[N,O,S]);!$(C=C-C-C-[N,O]);!$(C12=CC(=O)CCC1C3C(C4C(CCC4)CC3)CC2)]
fr_aryl_methyl [$(a-[CH3]),$(a-[CH2]-[CH3]),$(a-[CH2]-[CH2]~[!N;!O]);!$(a(:a!:*):a!:*)]
fr_Ndealkylation1 [$(N(-[CH3])-C-[$(C~O),$(C-a),$(C-N),$(C=C)]),$(N(-[CH2][CH3])-C-[$(C~O),$(C-a),$(C-N),$(C=C)])]
fr_Ndealkylation2 [$([N&R1]1(-C)CCC1),$([N&R1]1(-C)CCCC1),$([N&R1]1(-C)CCCCC1),$([N&R1]1(-C)CCCCCC1),$([N&R1]1(-C)CCCCCCC1)]
fr_alkyl_carbamate C[NH1]C(=O)OC
fr_ketone_Topliss [$([CX3](=[OX1])(C)([c,C]));!$([CX3](=[OX1])([CH1]=C)[c,C])]
fr_ArN [$(a-[NX3H2]),$(a-[NH1][NH2]),$(a-C(=[OX1])[NH1][NH2]),$(a-C(=[NH])[NH2])]
fr_HOCCN [$([OX2H1][CX4][CX4H2][NX3&R1]),$([OH1][CX4][CX4H2][NX3][CX4](C)(C)C)]
NumHDonors [$([N;!H0;v3]),$([N;!H0;+1;v4]),$([O,S;H1;+0]),$([n;H1;+0])]
NumHAcceptors [$([O,S;H1;v2]-[!$(*=[O,N,P,S])]),$([O,S;H0;v2]),$([O,S;-]),$([N;v3;!$(N-*=!@[O,N,P,S])]),$([nH0,o,s;+0])]
NOCount [#7,#8]
NumHeteroatoms [!#6;!#1]
NumAmideBonds C(=O)N
NumRotatableBonds [!$(*#*)&!D1&!$(C(F)(F)F)&!$(C(Cl)(Cl)Cl)&!$(C(Br)(Br)Br)&!$(C([CH3])([CH3])[CH3])&!$([CD3](=[N,O,S])-!@[#7,O,S!D1])&!$([#7,O,S!D1]-!@[CD3]=[N,O,S])&!$([CD3](=[N+])-!@[#7!D1])&!$([#7!D1]-!@[CD3]=[N+])]-!@[!$(*#*)&!D1&!$(C(F)(F)F)&!$(C(Cl)(Cl)Cl)&!$(C(Br)(Br)Br)&!$(C([CH3])([CH3])[CH3])]
"""

#: Further counted fragments.
_FRAGMENTS_MORE = """
fr_lactam N1C(=O)CC1
fr_benzodiazepine [c&R2]12[c&R1][c&R1][c&R1][c&R1][c&R2]1[N&R1][C&R1][C&R1][N&R1]=[C&R1]2
fr_barbitur C1C(=O)NC(=O)NC1=O
fr_azo [#6]-N=N-[#6]
fr_nitro_arom [$(c1(-[$([NX3](=O)=O),$([NX3+](=O)[O-])])ccccc1)]
fr_phenol_noOrthoHbond [$(c1(-[OX2H])ccccc1);!$(cc-!:[CH2]-[OX2H]);!$(cc-!:C(=O)[O;H1,-]);!$(cc-!:C(=O)-[NH2])]
fr_phos_ester [$(P(=[OX1])([OX2][#6])([$([OX2H]),$([OX1-]),$([OX2][#6])])[$([OX2H]),$([OX1-]),$([OX2][#6]),$([OX2]P)]),$([P+]([OX1-])([OX2][#6])([$([OX2H]),$([OX1-]),$([OX2][#6])])[$([OX2H]),$([OX1-]),$([OX2][#6]),$([OX2]P)])]
"""

#: Electrotopological atom types, name and pattern.
_ESTATE = """
sLi [LiD1]-*
ssBe [BeD2](-*)-*
ssssBe [BeD4](-*)(-*)(-*)-*
ssBH [BD2H](-*)-*
sssB [BD3](-*)(-*)-*
ssssB [BD4](-*)(-*)(-*)-*
sCH3 [CD1H3]-*
dCH2 [CD1H2]=*
ssCH2 [CD2H2](-*)-*
tCH [CD1H]#*
dsCH [CD2H](=*)-*
aaCH [C,c;D2H](:*):*
sssCH [CD3H](-*)(-*)-*
ddC [CD2H0](=*)=*
tsC [CD2H0](#*)-*
dssC [CD3H0](=*)(-*)-*
aasC [C,c;D3H0](:*)(:*)-*
aaaC [C,c;D3H0](:*)(:*):*
ssssC [CD4H0](-*)(-*)(-*)-*
sNH3 [ND1H3]-*
sNH2 [ND1H2]-*
ssNH2 [ND2H2](-*)-*
dNH [ND1H]=*
ssNH [ND2H](-*)-*
aaNH [N,nD2H](:*):*
tN [ND1H0]#*
sssNH [ND3H](-*)(-*)-*
dsN [ND2H0](=*)-*
aaN [N,nD2H0](:*):*
sssN [ND3H0](-*)(-*)-*
ddsN [ND3H0](~[OD1H0])(~[OD1H0])-,:*
aasN [N,nD3H0](:*)(:*)-,:*
ssssN [ND4H0](-*)(-*)(-*)-*
sOH [OD1H]-*
dO [OD1H0]=*
ssO [OD2H0](-*)-*
aaO [O,oD2H0](:*):*
sF [FD1]-*
sSiH3 [SiD1H3]-*
ssSiH2 [SiD2H2](-*)-*
sssSiH [SiD3H1](-*)(-*)-*
ssssSi [SiD4H0](-*)(-*)(-*)-*
sPH2 [PD1H2]-*
ssPH [PD2H1](-*)-*
sssP [PD3H0](-*)(-*)-*
dsssP [PD4H0](=*)(-*)(-*)-*
sssssP [PD5H0](-*)(-*)(-*)(-*)-*
sSH [SD1H1]-*
dS [SD1H0]=*
ssS [SD2H0](-*)-*
aaS [S,sD2H0](:*):*
dssS [SD3H0](=*)(-*)-*
ddssS [SD4H0](~[OD1H0])(~[OD1H0])(-*)-*
sCl [ClD1]-*
sGeH3 [GeD1H3](-*)
ssGeH2 [GeD2H2](-*)-*
sssGeH [GeD3H1](-*)(-*)-*
ssssGe [GeD4H0](-*)(-*)(-*)-*
sAsH2 [AsD1H2]-*
ssAsH [AsD2H1](-*)-*
sssAs [AsD3H0](-*)(-*)-*
sssdAs [AsD4H0](=*)(-*)(-*)-*
sssssAs [AsD5H0](-*)(-*)(-*)(-*)-*
sSeH [SeD1H1]-*
dSe [SeD1H0]=*
ssSe [SeD2H0](-*)-*
aaSe [SeD2H0](:*):*
dssSe [SeD3H0](=*)(-*)-*
ddssSe [SeD4H0](=*)(=*)(-*)-*
sBr [BrD1]-*
sSnH3 [SnD1H3]-*
ssSnH2 [SnD2H2](-*)-*
sssSnH [SnD3H1](-*)(-*)-*
ssssSn [SnD4H0](-*)(-*)(-*)-*
sI [ID1]-*
sPbH3 [PbD1H3]-*
ssPbH2 [PbD2H2](-*)-*
sssPbH [PbD3H1](-*)(-*)-*
ssssPb [PbD4H0](-*)(-*)(-*)-*
"""

#: Wildman-Crippen rows, pattern, logP and molar refractivity; the first that fits an atom holds.
_CRIPPEN = """
[CH4] 0.1441 2.503
[CH3]C 0.1441 2.503
[CH2](C)C 0.1441 2.503
[CH](C)(C)C 0.0 2.433
[C](C)(C)(C)C 0.0 2.433
[CH3][N,O,P,S,F,Cl,Br,I] -0.2035 2.753
[CH2X4]([N,O,P,S,F,Cl,Br,I])[A;!#1] -0.2035 2.753
[CH1X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])[A;!#1] -0.2051 2.731
[CH0X4]([N,O,P,S,F,Cl,Br,I])([A;!#1])([A;!#1])[A;!#1] -0.2051 2.731
[C]=[!C;A;!#1] -0.2783 5.007
[CH2]=C 0.1551 3.513
[CH1](=C)[A;!#1] 0.1551 3.513
[CH0](=C)([A;!#1])[A;!#1] 0.1551 3.513
[C](=C)=C 0.1551 3.513
[CX2]#[A;!#1] 0.0017 3.888
[CH3]c 0.08452 2.464
[CH3]a -0.1444 2.412
[CH2X4]a -0.0516 2.488
[CHX4]a 0.1193 2.582
[CH0X4]a -0.0967 2.576
[cH0]-[A;!C;!N;!O;!S;!F;!Cl;!Br;!I;!#1] -0.5443 4.041
[c][#9] 0.0 3.257
[c][#17] 0.245 3.564
[c][#35] 0.198 3.18
[c][#53] 0.0 3.104
[cH] 0.1581 3.35
[c](:a)(:a):a 0.2955 4.346
[c](:a)(:a)-a 0.2713 3.904
[c](:a)(:a)-C 0.136 3.509
[c](:a)(:a)-N 0.4619 4.067
[c](:a)(:a)-O 0.5437 3.853
[c](:a)(:a)-S 0.1893 2.673
[c](:a)(:a)=[C,N,O] -0.8186 3.135
[C](=C)(a)[A;!#1] 0.264 4.305
[C](=C)(c)a 0.264 4.305
[CH1](=C)a 0.264 4.305
[C]=c 0.264 4.305
[CX4][A;!C;!N;!O;!P;!S;!F;!Cl;!Br;!I;!#1] 0.2148 2.693
[#6] 0.08129 3.243
[#1][#6,#1] 0.123 1.057
[#1]O[CX4,c] -0.2677 1.395
[#1]O[!#6;!#7;!#8;!#16] -0.2677 1.395
[#1][!#6;!#7;!#8] -0.2677 1.395
[#1][#7] 0.2142 0.9627
[#1]O[#7] 0.2142 0.9627
[#1]OC=[#6,#7,O,S] 0.298 1.805
[#1]O[O,S] 0.298 1.805
[#1] 0.1125 1.112
[NH2+0][A;!#1] -1.019 2.262
[NH+0]([A;!#1])[A;!#1] -0.7096 2.173
[NH2+0]a -1.027 2.827
[NH1+0]([!#1;A,a])a -0.5188 3.0
[NH+0]=[!#1;A,a] 0.08387 1.757
[N+0](=[!#1;A,a])[!#1;A,a] 0.1836 2.428
[N+0]([A;!#1])([A;!#1])[A;!#1] -0.3187 1.839
[N+0](a)([!#1;A,a])[A;!#1] -0.4458 2.819
[N+0](a)(a)a -0.4458 2.819
[N+0]#[A;!#1] 0.01508 1.725
[NH3,NH2,NH;+,+2,+3] -1.95 0.0
[n+0] -0.3239 2.202
[n;+,+2,+3] -1.119 0.0
[NH0;+,+2,+3]([A;!#1])([A;!#1])([A;!#1])[A;!#1] -0.3396 0.2604
[NH0;+,+2,+3](=[A;!#1])([A;!#1])[!#1;A,a] -0.3396 0.2604
[NH0;+,+2,+3](=[#6])=[#7] -0.3396 0.2604
[N;+,+2,+3]#[A;!#1] 0.2887 3.359
[N;-,-2,-3] 0.2887 3.359
[N;+,+2,+3](=[N;-,-2,-3])=N 0.2887 3.359
[#7] -0.4806 2.134
[o] 0.1552 1.08
[OH,OH2] -0.2893 0.8238
[O]([A;!#1])[A;!#1] -0.0684 1.085
[O](a)[!#1;A,a] -0.4195 1.182
[O]=[#7,#8] 0.0335 3.367
[OX1;-,-2,-3][#7] 0.0335 3.367
[OX1;-,-2,-2][#16] -0.3339 0.7774
[O;-0]=[#16;-0] -0.3339 0.7774
[O-]C(=O) -1.326 0.0
[OX1;-,-2,-3][!#1;!N;!S] -1.189 0.0
[O]=c 0.1788 3.135
[O]=[CH]C -0.1526 0.0
[O]=C(C)([A;!#1]) -0.1526 0.0
[O]=[CH][N,O] -0.1526 0.0
[O]=[CH2] -0.1526 0.0
[O]=[CX2]=O -0.1526 0.0
[O]=[CH]c 0.1129 0.2215
[O]=C([C,c])[a;!#1] 0.1129 0.2215
[O]=C(c)[A;!#1] 0.1129 0.2215
[O]=C([!#1;!#6])[!#1;!#6] 0.4833 0.389
[#8] -0.1188 0.6865
[#9-0] 0.4202 1.108
[#17-0] 0.6895 5.853
[#35-0] 0.8456 8.927
[#53-0] 0.8857 14.02
[#9,#17,#35,#53;-] -2.996 0.0
[#53;+,+2,+3] -2.996 0.0
[+;#3,#11,#19,#37,#55] -2.996 0.0
[#15] 0.8612 6.92
[S;-,-2,-3,-4,+1,+2,+3,+5,+6] -0.0024 7.365
[S-0]=[N,O,P,S] -0.0024 7.365
[S;A] 0.6482 7.591
[s;a] 0.6237 6.691
[#3,#11,#19,#37,#55] -0.3808 5.754
[#4,#12,#20,#38,#56] -0.3808 5.754
[#5,#13,#31,#49,#81] -0.3808 5.754
[#14,#32,#50,#82] -0.3808 5.754
[#33,#51,#83] -0.3808 5.754
[#34,#52,#84] -0.3808 5.754
[#21,#22,#23,#24,#25,#26,#27,#28,#29,#30] -0.0025 0.0
[#39,#40,#41,#42,#43,#44,#45,#46,#47,#48] -0.0025 0.0
[#72,#73,#74,#75,#76,#77,#78,#79,#80] -0.0025 0.0
"""

#: Structural alerts of the drug-likeness score.
_ALERTS = """
*1[O,S,N]*1
[S,C](=[O,S])[F,Br,Cl,I]
[CX4][Cl,Br,I]
[#6]S(=O)(=O)O[#6]
[$([CH]),$(CC)]#CC(=O)[#6]
[$([CH]),$(CC)]#CC(=O)O[#6]
n[OH]
[$([CH]),$(CC)]#CS(=O)(=O)[#6]
C=C(C=O)C=O
n1c([F,Cl,Br,I])cccc1
[CH1](=O)
[#8][#8]
[C;!R]=[N;!R]
[N!R]=[N!R]
[#6](=O)[#6](=O)
[#16][#16]
[#7][NH2]
C(=O)N[NH2]
[#6]=S
[$([CH2]),$([CH][CX4]),$(C([CX4])[CX4])]=[$([CH2]),$([CH][CX4]),$(C([CX4])[CX4])]
C1(=[O,N])C=CC(=[O,N])C=C1
C1(=[O,N])C(=[O,N])C=CC=C1
a21aa3a(aa1aaaa2)aaaa3
a31a(a2a(aa1)aaaa2)aaaa3
a1aa2a3a(a1)A=AA=A3=AA=A2
c1cc([NH2])ccc1
[Hg,Fe,As,Sb,Zn,Se,se,Te,B,Si,Na,Ca,Ge,Ag,Mg,K,Ba,Sr,Be,Ti,Mo,Mn,Ru,Pd,Ni,Cu,Au,Cd,Al,Ga,Sn,Rh,Tl,Bi,Nb,Li,Pb,Hf,Ho]
I
OS(=O)(=O)[O-]
[N+](=O)[O-]
C(=O)N[OH]
C1NC(=O)NC(=O)1
[SH]
[S-]
c1ccc([Cl,Br,I,F])c([Cl,Br,I,F])c1[Cl,Br,I,F]
c1cc([Cl,Br,I,F])cc([Cl,Br,I,F])c1[Cl,Br,I,F]
[CR1]1[CR1][CR1][CR1][CR1][CR1][CR1]1
[CR1]1[CR1][CR1]cc[CR1][CR1]1
[CR2]1[CR2][CR2][CR2][CR2][CR2][CR2][CR2]1
[CR2]1[CR2][CR2]cc[CR2][CR2][CR2]1
[CH2R2]1N[CH2R2][CH2R2][CH2R2][CH2R2][CH2R2]1
[CH2R2]1N[CH2R2][CH2R2][CH2R2][CH2R2][CH2R2][CH2R2]1
C#C
[OR2,NR2]@[CR2]@[CR2]@[OR2,NR2]@[CR2]@[CR2]@[OR2,NR2]
[$([N+R]),$([n+R]),$([N+]=C)][O-]
[#6]=N[OH]
[#6]=NOC=O
[#6](=O)[CX4,CR0X3,O][#6](=O)
c1ccc2c(c1)ccc(=O)o2
[O+,o+,S+,s+]
N=C=O
[NX3,NX4][F,Cl,Br,I]
c1ccccc1OC(=O)[#6]
[CR0]=[CR0][CR0]=[CR0]
[C+,c+,C-,c-]
N=[N+]=[N-]
C12C(NC(N1)=O)CSC2
c1c([OH])c([OH,NH2,NH])ccc1
P
[N,O,S]C#N
C=C=O
[Si][F,Cl,Br,I]
[SX2]O
[SiR0,CR0](c1ccccc1)(c2ccccc2)(c3ccccc3)
O1CCCCC1OC2CCC3CCCCC3C2
N=[CR0][N,n,O,S]
[cR2]1[cR2][cR2]([Nv3X3,Nv4X4])[cR2][cR2][cR2]1[cR2]2[cR2][cR2][cR2]([Nv3X3,Nv4X4])[cR2][cR2]2
C=[C!r]C#N
[cR2]1[cR2]c([N+0X3R0,nX3R0])c([N+0X3R0,nX3R0])[cR2][cR2]1
[cR2]1[cR2]c([N+0X3R0,nX3R0])[cR2]c([N+0X3R0,nX3R0])[cR2]1
[cR2]1[cR2]c([N+0X3R0,nX3R0])[cR2][cR2]c1([N+0X3R0,nX3R0])
[OH]c1ccc([OH,NH2,NH])cc1
c1ccccc1OC(=O)O
[SX2H0][N]
c12ccccc1(SC(S)=N2)
c12ccccc1(SC(=S)N2)
c1nnnn1C=O
s1c(S)nnc1NC=O
S1C=CSC1=S
C(=O)Onnn
OS(=O)(=O)C(F)(F)F
N#CC[OH]
N#CC(=O)
S(=O)(=O)C#N
N[CH2]C#N
C1(=O)NCC1
S(=O)(=O)[O-,OH]
NC[F,Cl,Br,I]
C=[C!r]O
[NX2+0]=[O+0]
[OR0,NR0][OR0,NR0]
C(=O)O[C,H1].C(=O)O[C,H1].C(=O)O[C,H1]
[CX2R0][NX3R0]
c1ccccc1[C;!R]=[C;!R]c2ccccc2
[NX3R0,NX4R0,OR0,SX2R0][CX4][NX3R0,NX4R0,OR0,SX2R0]
[s,S,c,C,n,N,o,O]~[n+,N+](~[s,S,c,C,n,N,o,O])(~[s,S,c,C,n,N,o,O])~[s,S,c,C,n,N,o,O]
[s,S,c,C,n,N,o,O]~[nX3+,NX3+](~[s,S,c,C,n,N])~[s,S,c,C,n,N]
[*]=[N+]=[*]
[SX3](=O)[O-,OH]
N#N
F.F.F.F
[R0;D2][R0;D2][R0;D2][R0;D2]
[cR,CR]~C(=O)NC(=O)~[cR,CR]
C=!@CC=[O,S]
[#6,#8,#16][#6](=O)O[#6]
c[C;R0](=[O,S])[#6]
c[SX2][C;!R]
C=C=C
c1nc([F,Cl,Br,I,S])ncc1
c1ncnc([F,Cl,Br,I,S])c1
c1nc(c2c(n1)nc(n2)[F,Cl,Br,I])
[#6]S(=O)(=O)c1ccc(cc1)F
[15N]
[13C]
[18O]
[34S]
"""


FRAGMENTS = [tuple(x.split(None, 1)) for x in _FRAGMENTS.split("\n") if x]
FRAGMENTS_MORE = [tuple(x.split(None, 1)) for x in _FRAGMENTS_MORE.split("\n") if x]
ESTATE = [tuple(x.split(None, 1)) for x in _ESTATE.split("\n") if x]
CRIPPEN = [(p, float(a), float(b)) for p, a, b in (x.split() for x in _CRIPPEN.split("\n") if x)]
ALERTS = _ALERTS.split()

#: Coefficients and patterns of the linear solubility model.
SOLUBILITY = [
    (0.71535, "[NH0;X3;v3]"), (0.41056, "[NH2;X3;v3]"), (0.82535, "[nH0;X3]"), (0.31464, "[OH0;X2;v2]"),
    (0.14787, "[OH0;X1;v2]"), (0.62998, "[OH1;X2;v2]"), (-0.35634, "[CH2;!R]"), (-0.33888, "[CH3;!R]"),
    (-0.21912, "[CH0;R]"), (-0.23057, "[CH2;R]"), (-0.3757, "[ch0]"), (-0.22435, "[ch1]"), (-0.21728, "F"),
    (-0.49721, "Cl"), (-0.57982, "Br"), (-0.51547, "I"),
]
#: Acids and bases, any of which an atom may fit.
ACIDS = ["[O;H1]-[C,S,P]=O", "[*;-;!$(*~[*;+])]", "[NH](S(=O)=O)C(F)(F)F", "n1nnnc1"]
BASES = ["[NH2]-[CX4]", "[NH](-[CX4])-[CX4]", "N(-[CX4])(-[CX4])-[CX4]", "[*;+;!$(*~[*;-])]", "N=C-N", "N-C=N"]
