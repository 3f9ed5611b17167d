"""Abbreviation lists by language.

Lists hold at most about two hundred entries; larger dictionaries are a parameter: see ``profiles.with_abbreviations``.
Dotted forms such as ``a.b.c`` follow from a rule (``rules.INITIALISM``) and need no entry.
"""

from __future__ import annotations

# Abbreviations without their last period, in lower case.
EN = frozenset(
    """
    adj adm adv al ala alta approx apr arc ariz ark art assn asst attys aug avg ave bart bld bldg blvd brig bros
    btw cal calif capt cl cmdr co col colo comdr con conn corp cpl cres ct d.phil dak dec del dept det dist dr
    dr.phil dr.philos drs e.g eq ens esp esq est etc exp expy ext feb fed fla ft fwy fy ga gen gov govt hon hosp
    hr hway hwy i.e ia id ida ill inc ind ing insp is jan jr jul jun kan kans ken ky la lt ltd maj mar max mass
    may md me med messrs mex mfg mich misc min minn miss mlle mm mme mo mont mr mrs ms msgr mssrs mt mtn natl neb
    nebr nev no nos nov nr oct ok okla ont op ord ore orig p pa pd pde penn penna pfc ph ph.d pl plz pp prof pt
    pvt que rd rs ref rep reps res rev rt sask sec sen sens sep sept sfc sgt sr st supt surg tce tel tenn tex univ
    usafa u.s ut va v ver viz vol vs vt wash wis wisc wy wyo yuk fig
    """.split()
)

EN_BEFORE_NAME = frozenset(
    """
    adm attys brig capt cmdr col cpl det dr gen gov ing lt maj mr mrs ms mt messrs mssrs prof rep reps rev sen
    sens sgt st supt v vs
    """.split()
)

EN_BEFORE_NUMBER = frozenset(
    """
    approx art eq est ext fig no nos p pp pt tel vol
    """.split()
)

ES = frozenset(
    """
    a.c a/c abr adj admón afmo ago almte ap apdo arq art atte av avda bco bibl c c.f c.g c/c c/u cap cc.aa cdad cm
    co cra cta cv d.e.p da dcha dcho dep dic dicc dir dn doc dom dpto dr dra dto ee ej en entlo esq etc excmo ext
    f.c fca fdo febr ff.cc fig fil fra g.p g/p gob gr gral grs hnos hs igl iltre imp impr impto incl ing inst izdo
    izq izqdo j.c jue jul jun kg km lcdo ldo let lic ltd lun mar may mg min mié mm máx mín mt n.b no nos nov núm
    oct p p.a p.d p.ej p.v.p párrf ph.d pp ppal prev prof prov ptas pts pza pág págs párr q.e.g.e q.e.p.d q.e.s.m
    reg rep rte s s.a.r s.e s.l s.r.c s.r.l s.s.s s/n sdad seg sept sig sr sra sres srta sta sto sáb t.v.e tamb
    tel tfno ud uu uds univ v.b v.e vd vds vid vie vol vs vto
    """.split()
    + ['bs. as', 'ff. aa', 'n. del t', 'ntra. sra', 'rr. hh', 's. a']
)

ES_BEFORE_NAME = frozenset(
    """
    dr dra ee lic mt prof sr sra srta sta sto
    """.split()
)

ES_BEFORE_NUMBER = frozenset(
    """
    cra ext no nos p pp tel
    """.split()
)

FR = frozenset(
    """
    a.c.n a.m al ann apr art auj av b.p boul c.-à-d c.n c.n.s c.p.i c.q.f.d c.s ca cf ch.-l chap co contr dir dr
    e.g e.v env etc ex fasc fig fr fém hab i.e ibid id inf l.d lib ll.aa ll.aa.ii ll.aa.rr ll.aa.ss ll.ee ll.mm
    ll.mm.ii.rr loc.cit ltd m masc mm mme mmes mlle mlles ms n.b n.d n.d.a n.d.l.r n.d.t n.p.a.i n.s n/réf nn.ss
    no p p.c.c p.ex p.j p.s pl pp pr r.-v r.a.s r.i.p r.p s.a s.a.i s.a.r s.a.s s.e s.m s.m.i.r s.s sec sect sing
    sq sqq ss st ste suiv sup suppl t.s.v.p tél vb vol vs x.o z.i éd
    """.split()
)

FR_BEFORE_NAME = frozenset(
    """
    av dr mm mme mmes mlle mlles pr st ste
    """.split()
)

FR_BEFORE_NUMBER = frozenset(
    """
    art no p pp
    """.split()
)

DE = frozenset(
    """
    ä adj adm adv art asst b.a b.s bart bldg brig bros bse buchst bzgl bzw c.-à-d ca capt chr cmdr co col comdr
    con corp cpl d.h d.j dergl dgl dkr dr ens etc ev evtl ff g.g.a g.u gen ggf gov hon hosp i.f i.h.v ii iii insp
    iv ix jun k.o kath lfd lt ltd m.e maj med messrs mio mlle mm mme mr mrd mrs ms msgr mwst no nos nr o.ä op ord
    pfc ph pp prof pvt rep reps res rev rt s.p.a sa sen sens sfc sgt sog sogen spp sr st std str supt surg u.a u.e
    u.s.w u.u u.ä usf usw v vgl vi vii viii vs x xi xii xiii xiv xix xv xvi xvii xviii xx z.b z.t z.z z.zt zt zzt
    univ.-prof o.univ.-prof ao.univ.prof ass.prof hon.prof univ.-doz univ.ass stud.ass projektass ass di dipl.-ing
    mag
    """.split()
)

DE_BEFORE_NUMBER = frozenset(
    """
    art ca no nos nr pp
    """.split()
)

PL = frozenset(
    """
    ags alb ang aor awest bałt bojkow bret brus bsł bułg c.b.d.o c.b.d.u celt chorw cs czakaw czerw czes dłuż
    dniem dor dubrow duń ekaw fiń franc gal germ głuż gniem goc gr grudz hebr het hol ie ikaw irań irl islandz itd
    itp jekaw kajkaw kasz kirg kwiec łac lip listop lit łot lp maced mar młpol moraw n.e nb ngr niem nord norw np
    ok orm oset osk p.n p.n.e p.o pazdz pers pie podhal pol połab port prekm pskow psł rez rom rozdz rum rus rys
    sas sch scs serb sierp śl sła słe słi słow śrdniem śrgniem śrirl stbułg stind stpol stpr str strus stwniem
    stycz sztokaw szwedz t tj tłum toch tur tzn ukr ul umbr wed węg wlkpol włos wrzes wyd zakarp
    """.split()
    + ['i cont', 'pod red.', 'r cont', 'sp. z o.o']
)

SK = frozenset(
    """
    č no nr ing p red o.k a.d m.o pol.pr a.s.a.p p.n.l pp sl corp plgr tz rtg o.c.p c.k n.a a.m vz i.b ú.p.v.o
    bros rsdr doc tu ods n.w.a nár pedg paeddr rndr naprk a.g.p prof pr a.v por mvdr nešp u.s kt vyd e.t al ll.m
    o.f.i mr apod súkr stred s.e.g sr tvz ind var etc atd n.o s.a např a.i.i a.k.a konkr čsl odd ltd t.z o.z obv
    obr pok tel št skr phdr xx š.p ph.d m.n.m zz roz ev v.sp drsc mudr t.č el os co r.o str p.a zdravot prek gen
    viď dr cca p.s zák slov arm inc max d.c k.o soc bc zs akad sz pozn tr nám kol csc ul sp o.i jr zb sv tj čs tzn
    príp iv hl st pod vi tis stor rozh mld atď mgr a.s phd z.z judr hod vs písm s.r.o min ml iii t.j spol mil ii
    napr resp tzv
    """.split()
    + ['s. r. o', 'a. d', 'o. k', 'pol. pr', 'a. s. a. p', 'p. n. l', 'o. c. p', 'c. k', 'n. a', 'a. m', 'i. b', 'ú. p. v. o', 'n. w. a', 'a. g. p', 'a. v', 'u. s', 'e. t', 'll. m', 'o. f. i', 's. e. g', 'n. o', 's. a', 'a. i. i', 'a. k. a', 't. z', 'o. z', 'š. p', 'ph. d', 'm. n. m', 'v. sp', 't. č', 'r. o', 'p. a', 'p. s', 'a. r. k', 'd. c', 'k. o', 'a. s', 'z. z', 't. j']
)

SK_BEFORE_NAME = frozenset(
    """
    st dr mudr judr ing mgr bc drsc doc prof
    """.split()
)

SK_BEFORE_NUMBER = frozenset(
    """
    č no nr
    """.split()
)

BG = frozenset(
    """
    p.s акад ал б.р б.ред бел.а бел.пр бр бул в вж вкл вм вр г ген гр дж дм доц др ем заб зам инж к.с кв кв.м кг
    км кор куб куб.м л лв м м.г мин млн млрд мм н.с напр пл полк проф р рис с св сек см сп срв ст стр т т.г т.е
    т.н т.нар табл тел у ул фиг ха хил ч чл щ.д
    """.split()
)

RU = frozenset(
    """
    y y.e а авт адм.-терр акад англ в вв вкз вост.-европ г гг гос гр греч д деп дисс дол долл др ежедн ж жен з зап
    зап.-европ заруб и ин иностр инст исп итал к канд кв кг куб л л.h л.н лат м мин моск муж н нед нем о п пгт пер
    польск пп пр просп проф р руб рус с сек см спб ср стр т тел тов тт тыс у у.е ул ф фр ч чуваш
    """.split()
)

TL = frozenset(
    """
    bb bbg blg bp dis dr engr g gat gng hal hul hun jr kgg kon ma no nob okt pang pn prop set sr st sta
    """.split()
)

TL_BEFORE_NAME = frozenset(
    """
    bb dr engr g gat gng kgg kon ma pn sr sta
    """.split()
)

TL_BEFORE_NUMBER = frozenset(
    """
    blg bp hal no
    """.split()
)

RU_FINAL = frozenset(
    """
    англ греч др исп итал лат нем польск рус ср фр чуваш
    """.split()
)

LEGAL = frozenset(
    """
    app arb bankr cir crim fam prob sup surr aff'd cert rev'd reh'g vacated f.supp f.2d f.3d f.4th s.ct l.ed
    l.ed.2d u.s.c c.f.r fed.reg stat pub.l atty j jj ch mag aff amend app'x compl decl def defs dep ex mot op par
    paras pet pl pls proc reg regs resp stip supp syl ibid infra supra loc.cit op.cit passim arguendo seriatim
    agmt assgt auth cl eff encl exec guar indem jt lic mem mgmt mtg neg oblig prov provs pty recit sched subpar
    subsec approx admin comm'n comm'r dept div gov't legis mun nat'l twp
    """.split()
    + ['et al', 'sub nom']
)

LEGAL_BEFORE_NAME = frozenset(
    """
    atty j jj ch mag admin app arb bankr cir crim dist fam prob sup surr amend sched
    """.split()
)

LEGAL_BEFORE_NUMBER = frozenset(
    """
    par paras cl sec amend reg sched subsec subpar
    """.split()
)

EL = frozenset(
    """
    μ.χ π.χ ε.ε κ.λπ κ.ά κ.τ.λ αρ σελ βλ
    """.split()
)

AR = frozenset(
    """
    ا ا.د ا.ش.ا إلخ ت.ب ج.ب جم ج.م.ع س.ت سم ص.ب. ص.ب كج كلم م م.ب ه
    """.split()
    + ['ا. د']
)

IT = frozenset(
    """
    all arch art avv ag apr c.a cap capp cc ca cfr cit c.m c.p co col cons cost d.c dic dir dis doc dott dr dr.ssa
    ecc econ ed egr es etc fatt fasc feb fig figg f.lli f.p gen genn geom giu id idraul ill ing int km km/h lat
    lett lib lug mag mar max meteor min mitt mod mons mr ms n nn no nov nr nrr num obbl on op ott p pag pagg par
    part p.es p.s pp pres prof prov psicol racc rag red reg rev rif s s.a s.p.a s.r.l seg sen set sett sez sig
    sigg soc spett sr st succ suppl tab tel tit tr trad v v.cte ver vers vol voll vs
    """.split()
)

IT_BEFORE_NAME = frozenset(
    """
    arch avv col dir dott dr drs egr fatt gen geom gov ing lett lt maj mlle mme mons mr mrs ms msgr on prof psicol
    rag rev sen sgt sig sigg spett sr s.a s.n.c s.p.a s.r.l soc
    """.split()
)

IT_BEFORE_NUMBER = frozenset(
    """
    art no nos nr pp
    """.split()
)

NL = frozenset(
    """
    aanw aant adv afb afd al alg app apr art arr aug bijl bijv bijz bl blz bv ca cf co col dec deelw dhr diss div
    dr drs d.w.z e.a e.d eig enz etc evt ev excl feb fig fr geb gem gen ged hfst i.p.v i.v.m id ing ir incl inl
    int jan jl jr kl lt max maj med m.b.t mej mevr mgr min mr mv nl nov nr nrs o.a okt o.l.v o.m opm p pag par pl
    plm pp prof red resp sec secr sep sept sr st tab t.a.v t.b.v tel t.o.v t.w.v vert vgl vlgs vnw vol voorz w.o
    zgn zn
    """.split()
)

DA = frozenset(
    """
    adm adr afd afs al alm ang ank anm ann apr arr att aug aut bd bet bl.a bio bot ca cal cirk co ctr dav dec def
    dep dir disp distr dr ds dvs e.kr eftf egl eks ekskl ekspl el e.l em ent etc evt ex exam f fa fakt fam feb fhv
    fig fil flg forb foreg forf forh fork form forr fr frk f.eks f.kr fru fx gl g.d gr grdl hd hhv hj hr hrs i.e
    ib if ifm ill ing inkl instr int istf jan jf jr jul jun jur kap kat kbh kgl kl kld km komp kr kvt l lb lic
    lign lok lrs ltr m.a.o m.fl m.m m.v maj maks mar max md mdr mezz mfl mhp mht mia min mio mr mrk mrs ms mul ndf
    nedenn nk nov nr nto ny o.a o.lign obl okt omg omkr omr opg opl opr org orig osv ovenst p.a p.t pga pct perf
    pkt pl polit prof pr pt red ref reg regn rel resp s.d s.u sa sdr sek sen sep sept sg skr skt sml sn spec spm
    spr st stk str stud sub sv t.eks tab tdl tlf tir
    """.split()
)

DA_BEFORE_NAME = frozenset(
    """
    adm skt dr hr fru st
    """.split()
)

DA_BEFORE_NUMBER = frozenset(
    """
    nr s
    """.split()
)

KK = frozenset(
    """
    afp anp bae bg bp cd cgi er gp gps hrh icu idf imd ip kz kpa mri nba nbc nds pda pkk psp rss sms tnt usb utc x
    әқбк аақ авг.руб абб аек ак ақ акқ акт ала алм аөк апр аум ацат әч т б.т б ж.б т.б м а г ғ ғ.к д е ж з и к қ л
    н о ө п р с у ф х ц ч ш тг млн млрд мың км см мм кг гр м.м т.с.с ред рев проф акад доц инж инст каф көш қ.а
    обл ауд тел
    """.split()
)
