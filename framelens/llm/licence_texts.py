"""Token counts of licence texts by SPDX id (fixed values; "token:count", one-time tokens without count).

The Affero text is the GPL-3.0 one with its name and section 13 exchanged, not a copy of the published file.
"""

TEXTS = {
    "GPL-2.0": (
        "0 02110:2 1:7 10 11 12 1301:2 1989:2 1991:2 2:8 3 4 5 51:2 6 69 7 8 9 a:57 above:6 absence absolutely accept:2 acceptance access:2 accompanies "
        "accompany:3 accord achieve act:2 actions activities add:2 addition address addressed advised aggregation agreed agreement all:14 allegation allowed:2 "
        "along:3 also:5 alter alternative among an:9 and:72 announcement:3 another:2 any:38 anyone anything applicable:2 application applications applies:3 "
        "apply:6 appropriate:3 appropriately april are:13 arising as:21 ask:2 associated assume at:8 attach:2 attempt author:5 authors:2 automatically:2 avoid "
        "away b:3 balance based:12 be:16 because been:2 being believed below best binary body boston:2 both brief bring but:7 by:28 c:8 called can:8 cannot:2 "
        "carry case cause:3 certain:4 change:5 changed changing charge:5 choice choose circumstance circumstances claim claims:2 clear:2 clicks code:16 "
        "collective comes commands:3 commit compelled compilation compiler compilers complete:3 compliance:2 component components concerns conditions:13 "
        "consequence:3 consequential consider considered consistent conspicuously constantly constitute contact containing contains:3 contents contest:2 "
        "contradict contrast contributions control:2 convey coon:2 copies:8 copy:18 copying:4 copyright:14 copyrighted:2 correction corresponding:3 cost:2 "
        "could:2 countries:3 counts course court:2 covered:3 customarily:2 damages:3 danger data:2 date decide decision defective definition deny depends "
        "derivative:3 derivatives derived:2 designated designed:2 detail details:3 develop differ different directly disclaimer:2 disclaims display "
        "distinguishing distribute:19 distributed:7 distributing:2 distribution:16 do:8 document does:6 donor each:8 effect effectively either:7 electronic "
        "else:3 employer end enforcing entire:2 entirely:2 equivalent even:4 event ever every everyone:4 example:2 except:2 exception:2 exceptions exchange "
        "excluded excluding exclusion excuse executable:7 exercise:2 explicit expressed expressly extend extent failure fee:3 fifth:2 file:2 files:3 finally "
        "fitness:2 floor:2 follow following:3 for:39 forbid form:4 forming found foundation:10 franklin:2 free:28 freedom:4 from:10 full:2 further general:15 "
        "generally generous geographical get:3 give:4 given gives gnomovision:3 gnu:8 goals granted grants gratis greatest guarantee guided hacker has:2 "
        "have:11 having he held here hereby herein hereinafter holder:4 holders hope how:3 however:3 hypothetical idea identifiable if:32 implemented implied:3 "
        "impose:2 imposed in:29 inability inaccurate inc:3 incidental include included including:4 incorporate incorporates incorporating independent:2 "
        "indicate indirectly individually induce information:2 infringe infringement installation instead:2 intact integrity intended:4 intent:2 interactive:4 "
        "interactively interchange:2 interest interface interfaces into:3 introduced invalid is:53 issues it:39 items its:7 itself:2 james judgment june keep "
        "kernel kind know:3 language later:3 law:4 least:2 legal lesser:2 liable library:2 license:46 licensed:4 licensee:2 licensees licenses:4 licensor like "
        "limitation:3 limited:3 line:2 linking long loss losses ma:2 machine:2 made:4 mail major make:9 makes making:2 many may:17 means:3 medium:4 meet menu "
        "merchantability:2 mere mode modification:4 modifications:3 modified:4 modify:9 modifying:2 modules more:3 most:4 mouse must:9 name:3 names necessary:2 "
        "need:2 new:6 no:8 noncommercial normally:3 not:34 nothing notice:6 notices:3 number:3 object:4 obligations:2 obtain of:104 offer:5 offering:2 on:26 "
        "one:2 only:5 operate operating option:3 or:77 order ordinary original:4 other:18 others otherwise:3 our:3 ours out output:2 outside paper part:4 "
        "particular:3 parties:7 parts:2 party:3 passed passes patent:5 patents:3 people performance performing permission:3 permissions permit:3 permitted:4 "
        "pertinent physical physically pieces place:2 placed places plus:2 pointer portion:3 possibility possible practices preamble precise preferred present "
        "preserving president prevent price print:3 problems:2 program:71 programmer programs:6 prohibited prominent promoting property proprietary:3 protect:2 "
        "protecting protection:2 prove provide:2 provided:4 public:16 publish:3 published:3 purpose:4 quality range rather readable:2 reads reason reasonably "
        "receive:4 received:4 receives recipient recipients:4 redistribute:6 redistribution redistributors refer referring refers reflect refrain regardless "
        "reliance remain rendered repair reputations required:3 requirements responsibilities responsible rest restricted:2 restrictions:3 reuse revised "
        "right:2 rights:11 risk royalty run running:3 runs s:5 safest same:2 sample satisfy:2 say saying:2 school scope:2 scripts section:9 sections:6 see "
        "separate:2 service servicing share:2 sharing she short should:5 show:8 sign signature signed similar simultaneously since so:8 software:35 sole some "
        "someone something sometimes source:16 speak special:2 specifies specify spirit start started starts stated stating status steps storage street:2 "
        "subject sublicense:2 subroutine subsection such:12 suits sure:3 surrender sustained system:5 take telling term terminate terminated terms:18 than:3 "
        "that:35 the:194 their:2 them:3 themselves then:4 there:3 therefore thereof these:11 they:6 things third:5 this:49 thoroughly those:3 though threatened "
        "three through:3 thus:4 time:3 to:108 too:2 transferring translate translated translation true two:2 ty:2 type:2 under:19 understands unenforceable "
        "unless:2 up usa:2 use:9 used:3 useful:2 user users:2 using valid validity verbatim:3 version:13 versions:2 vice view void volume w:3 want:5 warranties "
        "warranty:13 way:3 we:9 welcome what:5 whatever when:7 where whether:3 which:10 who:5 whole:7 whose:3 wide will:8 willing wish:3 with:17 without:4 "
        "work:24 works:5 would:2 write:3 writing:2 written:4 wrote year:2 years you:76 your:20 yoyodyne "
    ),
    "GPL-3.0": (
        "0 1:6 10:4 11:3 12 13:2 14 15:3 16:3 17 1996 2:6 20 2007:3 28 29 3:6 30 4:4 5:2 6 60 6b 6d 7:4 8 9 a:184 ability about above:3 absence absolute "
        "absolutely abuse accept:2 acceptance:4 access:6 accessible accompanied:3 accompanies accord:4 according achieve acknowledges acquired:2 across actions "
        "activities:3 activity actual actually adapt add:4 added:3 additional:14 address addressed adopted adversely advised affects affero:3 affirmed affirms "
        "after:2 against:2 aggregate:3 agree agreed agreement:3 aim all:21 alleging allow allowed:3 along:5 already also:7 alternative although among an:26 "
        "ancillary and:98 anti any:50 anyone:4 anything:4 applicable:9 applications applied applies:2 apply:14 appropriate:8 appropriately approximates are:28 "
        "area arise arising arrange:2 arrangement:3 article as:38 asking assert assets associated assume assumption assumptions:2 assures at:8 attach:2 attempt "
        "attributed attributions author:4 authorization authorized authorizes:2 authorizing authors:7 automatic automatically:4 available:9 avoid away b:6 "
        "based:6 basic be:29 because been:6 behalf being:2 believe below benefit best between beyond body both:2 box brief business but:16 by:43 c:8 called:3 "
        "can:13 cannot:3 carry:2 case:2 cases:2 cause:2 cease certain:4 cessation change:5 changed changing characterized charge:8 choose:2 choosing "
        "circumstances circumvention:5 civil claim:2 claims:4 class clear clearly closely code:34 collect combination combine combined:2 comes:2 commands:3 "
        "commercial commitment:2 common communication:2 compilation:3 compilations compiler compliance comply component:5 computer:2 computers concerning "
        "concerns conditioned conditions:14 connection:4 consequence:3 consequential consider considered consistent:2 conspicuously constantly constitutes "
        "construed consumer:4 contact contain containing contains:2 content contents context continue:2 continued contractual:2 contradict contrast "
        "contributor:10 control:6 controlled convenient convey:26 conveyance conveyed:3 conveying:15 conveys:2 copies:14 copy:25 copying:4 copyleft "
        "copyright:30 copyrightable copyrighted correction corresponding:23 cost:2 could:3 counterclaim countries country:3 course court courts covenant "
        "coverage:2 covered:41 criterion cross cure customarily:2 customer d:3 damages:3 danger data:3 date days:2 december decide declining deemed defective "
        "defenses defined definition:2 definitions denied denominated deny denying deprive designated designed:6 detail details:3 determining develop "
        "developers:3 development devices differ different:4 differently direction directions directly:2 disclaim disclaimer:3 disclaiming discriminatory:2 "
        "display:2 displayed displays:2 distinguishing distribute:5 distributed distributing distribution:5 do:16 document:3 documented does:13 domains:2 "
        "doubtful downstream:2 durable:2 dwelling dynamically e:2 each:10 earlier:2 effect effected effective effectively:2 efforts either:9 electronic "
        "embodied:2 employer enable enables end enforce:2 enforcing:2 ensure:2 entered entire:4 entirely entity:2 equivalent:3 erroneously essential:3 even:2 "
        "event ever every everyone:2 exact example:5 except:4 exceptions:2 excluded excluding exclusion exclusive exclusively:2 excuse executable:3 execute "
        "executing exercise:4 exercising expected expects explains explicitly:2 express:2 expressed expressly extend:2 extended extensions extent:6 f "
        "facilities:2 fails failure fair family fashion favor feature fee:4 file:2 files:4 finally:2 find:2 first:2 fitness:2 fixed:2 flow follow:3 following:3 "
        "for:86 forbid:2 force form:11 format forms found foundation:6 free:20 freedom:8 freedoms from:29 fsf fulfilling full functioning fundamentally "
        "further:8 future:2 general:23 generally generate get:4 give:6 given:3 gives giving:2 gnu:22 governed:3 gpl:7 grant:5 granted:7 grants:3 gratis:2 "
        "greatest guarantee gui had has:9 have:14 having:2 hereafter holder:10 holders:2 hope hosts household how:6 however:6 html https:4 hypothetical idea "
        "identifiable if:49 implement implementation:2 implied:4 import importing impose:3 imposed:2 in:81 inability inaccurate inc incidental include:6 "
        "included:3 includes:4 including:8 inclusion incompatible incorporating incorporation indemnification independent indicate indicating individual:2 "
        "individuals:2 industrial inform information:8 infringe:2 infringed:3 infringement:3 initiate inside install:4 installation:4 installed:3 instead "
        "intact:3 intended intention interaction:3 interactive:4 interchange:2 interest:2 interface:7 interfaces:3 interfered interpretation interpreter "
        "intimate into:5 invalidate irrevocable is:70 it:52 item its:10 itself june keep:3 kernel key keys kind:2 kinds:2 know:2 knowingly:2 knowledge "
        "language:2 larger later:5 law:10 laws:2 lawsuit least:2 legal:11 lesser lgpl liability:7 liable:2 libraries:3 library:3 license:102 licensed:3 "
        "licensee licensees:2 licenses:9 licensing licensors:4 like:2 likewise limit:2 limitation:2 limited:2 limiting:3 line:2 link linked linking list:2 "
        "litigation local:2 long:3 loss losses machine made:2 mail maintain major:5 make:14 makes making:8 manner:3 manufacturer march marked:2 marks masks "
        "material:13 materially may:31 meaning means:18 measure measures:3 medium:6 meet meets menu merchantability:2 mere merging met methods might "
        "misrepresentation mode:2 model modification:6 modifications:3 modified:13 modifies:2 modify:12 modifying:2 more:7 moreover most:5 must:14 name:3 "
        "names:2 nature necessary:2 need:5 needed:3 neither network:8 new:7 next no:17 non:9 noncommercially nor normal normally:2 not:51 nothing:2 notice:8 "
        "notices:11 notifies notify notwithstanding:2 number:2 numbered:2 object:21 obligate obligated obligations:4 occasionally occurring occurs:2 of:221 "
        "offer:8 offered offering:2 official on:31 one:7 only:8 operate operated operating operation:2 option:3 options or:151 order:2 org:4 organization:2 "
        "organizations:2 origin original:2 other:30 others:4 otherwise:6 our:2 out output:3 outside own owned packaged packaging paper paragraph:2 paragraphs "
        "part:10 particular:10 parties:8 parts:6 party:12 pass password patent:23 patents:6 pattern payment peer:4 peers performance performing:2 permanently:4 "
        "permission:10 permissions:10 permissive:4 permit:3 permits permitted:5 perpetuity personal:2 pertinent physical:6 physically pieces place:5 please "
        "plus pointer portion:2 possesses possession:3 possibility possible power practical practice:2 preamble precise precisely predecessor:3 preferred "
        "present presents preservation prevent:2 prevented previous:2 price:4 primarily prior:3 private problems:3 procedures procuring produce:2 product:21 "
        "products:3 program:52 programmer programming programs:6 prohibit:2 prohibiting:2 prohibits prominent:3 prominently propagate:9 propagating "
        "propagation:4 property proprietary:3 protect:3 protecting:2 protection:2 protocols prove provide:5 provided:13 provision:3 provisionally proxy:2 "
        "public:25 publicity publicly:2 publish:2 published:3 purpose:5 purposes:3 pursuant qualify quality read readable readily reading ready reason "
        "reasonable:6 receipt receive:8 received:8 receives:3 receiving recipient:5 recipients:7 recognized redistribute:3 referring refers:3 refrain regard "
        "regardless:5 regenerate reinstated:3 relationship released:2 relevant:2 relicensing:2 relying:2 remain remains:3 removal remove:2 render rendered "
        "repair represent require:5 required:4 requirement:5 requirements:5 requires requiring:4 resolved respect:2 responsibilities:2 responsible restrict "
        "restricting restriction:3 restrictions:2 result resulting:3 results retains return reviewing revised:2 right:3 rights:19 risk rom royalty:3 rules "
        "run:8 running:3 runs s:12 safest sake sale:2 same:5 satisfy:3 saying school scope scripts secondarily section:15 sections:3 see:3 sell selling:2 "
        "semiconductor separable separate separately:3 server:5 serves service:2 servicing shall:5 share:2 shared short should:6 show:6 sign significant "
        "similar:2 simultaneously single:2 so:11 software:27 sold sole solely:3 some:7 source:42 spare speak special:4 specific:3 specifically:3 specified:2 "
        "specifies:2 specify spirit stand standard:3 standards start starts state stated:5 statement:2 states stating:4 status steps storage subdividing "
        "subject sublicenses sublicensing subprograms:2 subroutine subsection:2 substantial substantially:2 such:21 sue suffice supplement:2 support:3 supports "
        "sure:3 surrender:2 survive sustained system:5 systematic take tangible technological:3 tells term:4 terminal terminate:2 terminated terminates "
        "termination:2 terms:32 than:4 that:91 the:345 their:6 them:8 then:4 there:3 therefore:4 these:10 they:6 things third:9 this:86 those:14 though "
        "threatened three:2 through:4 thus:2 time:4 to:192 too:2 tools trade trademark trademarks transaction:7 transfer transferred transferring "
        "transmission:2 treated treaty two type:2 typical unacceptable under:44 unless:5 unlimited unmodified:3 unnecessary unpacking until updates use:24 "
        "used:12 useful:2 user:15 users:9 uses:3 using:4 valid:4 verbatim:3 version:25 versions:14 view violates violation:5 visible void volume w:2 waive "
        "waiver want:3 warranties:2 warranty:15 was way:7 ways:2 we:7 welcome well were what:4 whatever when:7 where:5 whether:5 which:21 who:8 whole:3 whom "
        "whose why widely will:8 window wipo wish:2 with:45 within:2 without:7 work:97 working works:12 worldwide would:7 writing:2 written:4 www:3 year:2 "
        "years you:128 your:34 yourself "
    ),
    "AGPL-3.0": (
        "0 1:6 10:4 11:3 12 13 14 15:3 16:3 17 1996 2:6 20 2007:3 28 29 3:8 30 4:4 5:2 6 60 6b 6d 7:4 8 9 a:185 ability about above:3 absence absolute "
        "absolutely abuse accept:2 acceptance:4 access:7 accessible accompanied:3 accompanies accord:4 according achieve acknowledges acquired:2 across actions "
        "activities:3 activity actual actually adapt add:4 added:3 additional:14 address addressed adopted adversely advised affects affero:13 affirmed affirms "
        "after:2 against:2 aggregate:3 agree agreed agreement:3 aim all:22 alleging allow allowed:3 along:5 already also:7 alternative although among an:27 "
        "ancillary and:98 anti any:52 anyone:4 anything:4 applicable:9 applications applied applies:2 apply:13 appropriate:8 appropriately approximates are:28 "
        "area arise arising arrange:2 arrangement:3 article as:37 asking assert assets associated assume assumption assumptions:2 assures at:9 attach:2 attempt "
        "attributed attributions author:4 authorization authorized authorizes:2 authorizing authors:7 automatic automatically:4 available:9 avoid away b:6 "
        "based:6 basic be:29 because been:6 behalf being:2 believe below benefit best between beyond body both:2 box brief business but:16 by:46 c:8 called:3 "
        "can:13 cannot:3 carry:2 case:2 cases:2 cause:2 cease certain:4 cessation change:5 changed changing characterized charge:9 choose:2 choosing "
        "circumstances circumvention:5 civil claim:2 claims:4 class clear clearly closely code:34 collect combine combined:3 comes:2 commands:3 commercial "
        "commitment:2 common communication:2 compilation:3 compilations compiler compliance comply component:5 computer:3 computers concerns conditioned "
        "conditions:14 connection:4 consequence:3 consequential consider considered consistent:2 conspicuously constantly constitutes construed consumer:4 "
        "contact contain containing contains:2 content contents context continue:2 continued contractual:2 contradict contrast contributor:10 control:6 "
        "controlled convenient convey:26 conveyance conveyed:3 conveying:15 conveys:2 copies:14 copy:25 copying:5 copyleft copyright:30 copyrightable "
        "copyrighted correction corresponding:27 cost:2 could:3 counterclaim countries country:3 course court courts covenant coverage:2 covered:42 criterion "
        "cross cure customarily:2 customary customer d:3 damages:3 danger data:3 date days:2 december decide declining deemed defective defenses defined "
        "definition:2 definitions denied denominated deny denying deprive designated designed:6 detail details:3 determining develop developers:3 development "
        "devices differ different:4 differently direction directions directly:2 disclaim disclaimer:3 disclaiming discriminatory:2 display:2 displayed "
        "displays:2 distinguishing distribute:5 distributed distributing distribution:5 do:16 document:3 documented does:13 domains:2 doubtful downstream:2 "
        "durable:2 dwelling dynamically e:2 each:10 earlier:2 effect effected effective effectively:2 efforts either:9 electronic embodied:2 employer enable "
        "enables end enforce:2 enforcing:2 ensure:2 entered entire:4 entirely entity:2 equivalent:3 erroneously essential:3 even:2 event ever every everyone:2 "
        "exact example:5 except:4 exceptions:2 excluded excluding exclusion exclusive exclusively:2 excuse executable:3 execute executing exercise:4 exercising "
        "expected expects explains explicitly:2 express:2 expressed expressly extend:2 extended extensions extent:6 f facilitating facilities:2 fails failure "
        "fair family fashion favor feature fee:4 file:2 files:4 finally:2 find:2 first:2 fitness:2 fixed:2 flow follow:3 following:4 for:87 forbid:2 force "
        "form:11 format forms found foundation:6 free:20 freedom:8 freedoms from:30 fsf fulfilling full functioning fundamentally further:8 future:2 general:24 "
        "generally generate get:4 give:6 given:3 gives giving:2 gnu:23 governed:4 gpl:7 grant:5 granted:7 grants:3 gratis:2 greatest guarantee gui had has:9 "
        "have:14 having:2 hereafter holder:10 holders:2 hope hosts household how:6 however:6 html https:4 hypothetical idea identifiable if:51 implement "
        "implementation:2 implied:4 import importing impose:3 imposed:2 in:81 inability inaccurate inc incidental include:7 included:3 includes:4 including:8 "
        "inclusion incompatible incorporated incorporating incorporation indemnification independent indicate indicating individual:2 individuals:2 industrial "
        "inform information:8 infringe:2 infringed:3 infringement:3 initiate inside install:4 installation:4 installed:3 instead intact:3 intended intention "
        "interacting interaction:4 interactive:4 interchange:2 interest:2 interface:7 interfaces:3 interfered interpretation interpreter intimate into:5 "
        "invalidate irrevocable is:72 it:54 item its:10 itself june keep:3 kernel key keys kind:2 kinds:2 know:2 knowingly:2 knowledge language:2 larger "
        "later:5 law:10 laws:2 lawsuit least:2 legal:11 lesser lgpl liability:7 liable:2 libraries:3 library:3 license:104 licensed:3 licensee licensees:2 "
        "licenses:9 licensing licensors:4 like:2 likewise limit:2 limitation:2 limited:2 limiting:3 line:2 link linked linking list:2 litigation local:2 long:3 "
        "loss losses machine made:2 mail maintain major:5 make:14 makes making:8 manner:3 manufacturer march marked:2 marks masks material:13 materially may:31 "
        "meaning means:19 measure measures:3 medium:6 meet meets menu merchantability:2 mere merging met methods might misrepresentation mode:2 model "
        "modification:6 modifications:3 modified:14 modifies:2 modify:13 modifying:2 more:7 moreover most:5 must:15 name:3 names:2 nature necessary:2 need:5 "
        "needed:3 neither network:10 new:7 next no:18 non:9 noncommercially nor normal normally:2 not:51 nothing:2 notice:8 notices:11 notifies notify "
        "notwithstanding:3 number:2 numbered:2 object:21 obligate obligated obligations:4 occasionally occurring occurs:2 of:226 offer:9 offered offering:2 "
        "official on:31 one:7 only:8 operate operated operating operation:2 opportunity option:3 options or:152 order:2 org:4 organization:2 organizations:2 "
        "origin original:2 other:31 others:4 otherwise:6 our:2 out output:3 outside own owned packaged packaging paper paragraph:3 paragraphs part:10 "
        "particular:10 parties:8 parts:6 party:12 pass password patent:23 patents:6 pattern payment peer:4 peers performance performing:2 permanently:4 "
        "permission:10 permissions:10 permissive:4 permit:3 permits permitted:5 perpetuity personal:2 pertinent physical:6 physically pieces place:5 please "
        "plus pointer portion:2 possesses possession:3 possibility possible power practical practice:2 preamble precise precisely predecessor:3 preferred "
        "present presents preservation prevent:2 prevented previous:2 price:4 primarily prior:3 private problems:3 procedures procuring produce:2 product:21 "
        "products:3 program:53 programmer programming programs:6 prohibit:2 prohibiting:2 prohibits prominent:3 prominently:2 propagate:9 propagating "
        "propagation:4 property proprietary:3 protect:3 protecting:2 protection:2 protocols prove provide:5 provided:13 providing provision:4 provisionally "
        "proxy:2 public:26 publicity publicly:2 publish:2 published:3 purpose:5 purposes:3 pursuant:2 qualify quality read readable readily reading ready "
        "reason reasonable:6 receipt receive:9 received:8 receives:3 receiving recipient:5 recipients:7 recognized redistribute:3 referring refers:3 refrain "
        "regard regardless:5 regenerate reinstated:3 relationship released:2 relevant:2 relicensing:2 relying:2 remain:2 remains:3 remote remotely removal "
        "remove:2 render rendered repair represent require:5 required:4 requirement:5 requirements:4 requires requiring:4 resolved respect:2 responsibilities:2 "
        "responsible restrict restricting restriction:3 restrictions:2 result resulting:3 results retains return reviewing revised:2 right:3 rights:19 risk rom "
        "royalty:3 rules run:8 running:3 runs s:12 safest sake sale:2 same:5 satisfy:3 saying school scope scripts secondarily section:14 sections:3 see:3 sell "
        "selling:2 semiconductor separable separate separately:3 server:6 serves service:2 servicing shall:6 share:2 shared short should:6 show:6 sign "
        "significant similar:2 simultaneously single:2 so:11 software:28 sold sole solely:3 some:8 source:46 spare speak special:3 specific:3 specifically:3 "
        "specified:2 specifies:2 specify spirit stand standard:4 standards start starts state stated:5 statement:2 states stating:4 status steps storage "
        "subdividing subject sublicenses sublicensing subprograms:2 subroutine subsection:2 substantial substantially:2 such:21 sue suffice supplement:2 "
        "support:3 supports:2 sure:3 surrender:2 survive sustained system:5 systematic take tangible technological:3 tells term:4 terminal terminate:2 "
        "terminated terminates termination:2 terms:32 than:4 that:92 the:350 their:6 them:8 then:4 there:3 therefore:4 these:10 they:6 things third:9 this:88 "
        "those:14 though threatened three:2 through:5 thus:2 time:4 to:194 too:2 tools trade trademark trademarks transaction:7 transfer transferred "
        "transferring transmission:2 treated treaty two type:2 typical unacceptable under:44 unless:5 unlimited unmodified:3 unnecessary unpacking until "
        "updates use:24 used:12 useful:2 user:15 users:10 uses:3 using:4 valid:4 verbatim:3 version:30 versions:14 view violates violation:5 visible void "
        "volume w:2 waive waiver want:3 warranties:2 warranty:15 was way:7 ways:2 we:7 welcome well were what:4 whatever when:7 where:5 whether:5 which:22 "
        "who:8 whole:3 whom whose why widely will:8 window wipo wish:2 with:47 within:2 without:7 work:99 working works:12 worldwide would:7 writing:2 "
        "written:4 www:3 year:2 years you:129 your:37 yourself "
    ),
    "LGPL-2.1": (
        "0 02110:2 1:11 10 11 12 13 1301:2 14 15 16 1990 1991 1999:2 2:13 2d 3 4 5 51:2 6:5 6a 7 8 9 a:123 able about above:9 absence accept:2 acceptance "
        "access:4 accessors accompanies accompany:5 accompanying achieve act:2 actions activities add:2 addition address addressed advantage advantages advised "
        "affected after aggregation agreed agreement:2 all:16 allegation allowed:2 along:3 already:3 also:10 alter:2 alternatively although among:2 an:12 "
        "and:91 another:2 any:39 anything appeared applicable:2 application:8 applies:5 apply:7 appropriate appropriately april are:18 argument arising as:30 "
        "ask:2 associated assume at:7 attach:2 attempt attention author:4 authorized authors automatically:2 away b:3 balance based:16 be:29 because:3 becomes "
        "been:2 being:2 believed below:2 better between binary body:2 boston:2 both:2 brief bring but:8 by:39 c:5 call called:2 can:13 cannot:4 carefully carry "
        "case:4 cases cause:2 certain:6 change:7 changed changes:3 changing charge:5 choice:2 choose circumstance circumstances:2 claim claims:2 clear:2 close "
        "code:23 collection collective combination:2 combine combined:5 company compatible compelled competing compilation compiled compiler complete:6 "
        "compliance:2 component components compute:2 computer concerns conditions:11 consequence:3 consequential considered consistent:2 conspicuously constant "
        "constitute contact containing:5 contains:5 contents:2 contest:2 contradict contradiction contradicts contrast contributions control:2 conveniently "
        "convey coon:2 copies:9 copy:30 copying:5 copyright:14 copyrighted:2 correction corresponding:2 cost:2 could countries:3 counts court:2 covered:6 "
        "creates criteria:2 customarily customer d:2 damages:3 data:7 date de debugging decide:2 decision defective defined:2 definition definitions:2 deny "
        "depends derivative:12 derivatives derived:2 designated:4 designed:3 detail details develop developers differ difference different directing directly:2 "
        "disadvantages disclaimer:2 disclaims displays distinguishing distribute:23 distributed:9 distributing:2 distribution:17 distributor distributors do:11 "
        "document does:10 donor during e each:9 effectively:2 effort either:7 electronic else:2 employer enables:2 encourage end enforcing engineering ensure:2 "
        "entire:3 entirely:3 equivalent:2 especially even:4 event:2 ever every everyone:2 example:5 except:2 exception:2 exceptions exchange excluded excluding "
        "exclusion excuse executable:11 executables:4 execution exercise:2 existence explaining explanations explicit expressed expressly extend extent "
        "facilities:4 facility:4 fact facto failure faith fall:2 falls february fee:3 fifth:2 file:5 files:5 finally find first:2 fitness:2 fits floor:2 follow "
        "following:2 for:53 forbid form:6 former forming found foundation:9 franklin:2 free:36 freedom:9 frequent frob from:17 full:3 function:6 functions:4 "
        "further gain gave general:27 generally generous geographical get:3 give:5 given:3 gives gnu:17 goals good gpl granted grants gratis greater greatest "
        "guarantee guided hacker happen has:7 have:10 he header held hence here hereby herein hereinafter holder:5 holders hope how:2 however:5 idea "
        "identifiable if:40 implemented implied:3 impose:2 imposed in:45 inability inaccurate inc:3 incidental include:3 included including:5 incompatible "
        "incorporate incorporates independent:3 indicate indirectly induce information informed infringe infringement inline insist installation installs "
        "instead:3 intact integrity intended:4 intent:2 interchange interest interface:2 interfaces into:5 introduced invalid invoked irreversible is:79 "
        "isolation issues it:50 its:10 itself:4 james job judgment keep kernel kind knobs know:2 language large later:3 latter law:5 lax layouts least:2 legal "
        "legally:2 length less:4 lesser:15 liable libraries:9 library:140 license:76 licensed:2 licensee:2 licensees licenses:4 licensor limitation:3 limited:3 "
        "limiting line:2 lines link:5 linked:7 linking:5 linux little long:2 loss losses ma:2 machine:3 macros made:6 mail major make:10 making:3 many:3 "
        "material materials:4 may:21 meaningful means:5 mechanism:2 medium:3 meet merchantability:2 mere method might modification:5 modifications:4 "
        "modified:11 modify:10 modifying:2 modules more:5 most:3 must:23 name:2 names necessarily necessary:2 need:3 needed new:6 newer no:7 non:6 normally:2 "
        "not:41 nothing notice:6 notices:6 number:5 numerical object:10 obligations:2 obtained obtaining occasions of:160 offer:4 offering:3 on:30 once one:4 "
        "only:6 operate:2 operates operating:4 opt option:4 optional or:80 order:3 ordinary:11 original:5 other:26 others otherwise:5 our:3 out output "
        "outside:2 over own packages paper parameters part:6 particular:5 parties:7 parts party:3 passed:2 patent:5 patents:3 pay people:3 performance "
        "performing performs permission:5 permissions permit:3 permits:2 permitted:5 permitting pertinent physical pieces place:5 placed places plus:3 pointer "
        "portion:5 portions:3 pose possibility possible:2 practices preamble precise precisely preferred prepared present:2 preserving president price "
        "problems:2 produce:2 program:12 programmer programs:9 prohibited prominent:3 promoting properly property proprietary protect:4 protecting protection "
        "protective prove provide:2 provided:7 provides:2 public:29 publish:2 published:3 purpose:6 quality quite random range rare rather:3 readable:3 "
        "reason:2 reasonably receive:4 received:3 receives recipient recipients:4 recommend recompile recompiling redistribute:4 redistribution:2 refer:3 "
        "reference referring refers:2 refrain regardless:2 released reliance relink:2 remain remains rendered repair reproducing reputation required:3 "
        "requirement:2 requirements requires responsibilities responsible rest restrict restricted:2 restrictions:4 restrictive reuse reverse revised right:2 "
        "rights:11 risk root roots:2 royalty run:3 running runs s:7 safest same:7 sample satisfies satisfy:2 say saying school scope:3 scripts section:13 "
        "sections:8 see sent separate:3 service servicing share:2 shared:2 sharing she should:5 show side:2 sign signature signed significant similar "
        "simultaneously since single small:2 so:15 software:35 sole some:3 someone sometimes source:15 speak speaking special:4 specially specified:3 specifies "
        "specify:2 spirit square:3 standard start stated states statically stating status step still:3 storage straightforwardly strategy street:2 structure "
        "subject sublicense:2 subsection:2 subsequent successor such:17 suggest suitable:2 supplied:2 supply:3 sure:4 surrender sustained system:9 table:3 take "
        "ten term terminate terminated terms:26 than:7 that:79 the:349 their:2 them:6 themselves then:8 there:5 therefore:6 these:19 they:8 things:3 think "
        "third:4 this:67 thoroughly those:5 though:2 threat three threshold through:3 thus:4 time:4 to:140 together:2 too:2 tool transferring translate "
        "translated translation true:3 tweaking two:4 ty:2 typically uncombined:2 under:24 understood unenforceable unless:2 unrestricted up usa:2 use:27 "
        "used:6 useful:2 user:10 users:3 uses:13 using:3 utility valid validity variant verbatim:3 verify version:25 versions:2 very vice void volume want:3 "
        "warranties warranty:10 was way we:17 well:3 were what:5 whatever:2 when:8 where:2 whereas wherewithal whether:8 which:11 who:7 whole:7 whose:2 wide "
        "widely widest will:10 willing wish:5 with:42 without:5 work:58 works:6 would:2 write:3 writing:3 written:4 wrote year years you:88 your:15 yoyodyne "
    ),
    "LGPL-3.0": (
        "0:2 1:2 2 2007:2 29 3:8 4:2 4d0 4d1 5 6:4 a:44 acceptance accessors accompany:4 accompanying additional:3 address allowed already also:2 among an:9 "
        "and:30 any:8 applicable application:14 applications applies apply are:6 argument as:8 at authorization b:5 based:5 be:3 being below:2 both:2 bound "
        "but:5 by:17 c:2 called can certain changing choice:3 choose:2 class code:11 combined:21 combining compatible computer concerns conditions:2 considered "
        "contained convey:6 conveyed conveying:3 copies:2 copy:10 copyright:3 corresponding:9 covered:5 d data:4 debugging decide deemed defined:2 defining "
        "definitions detail differ directing displays distinguishing distribute do:5 document:4 does:2 during e each:4 effectively effort either engineering "
        "ensure event ever everyone exception excluding:2 execute execution explaining extent facilities:3 facility:4 faith fewer file files find following:5 "
        "for:15 form:3 foundation:4 free:4 from:4 fsf function:2 functions future general:11 give:3 given gnu:21 good governed gpl:10 have header:2 herein "
        "https if:10 in:13 inc include including incorporate incorporated incorporates incorporating information:5 inline install installation:3 interface:3 "
        "invoked is:18 isolation it:8 its:3 june later:2 layouts length lesser:9 libraries:2 library:34 license:25 limited lines linked:5 linking:2 listed "
        "macros made make makes manner:2 material:3 may:9 meaningful means:2 mechanism:2 minimal:3 mode modification modifications:2 modified:7 modify must:2 "
        "necessary needed new:3 none not:9 notice:4 notices:2 number:2 numbered numerical object:6 of:60 on:7 one:2 only:2 operate operates option:3 or:14 org "
        "other:4 otherwise:2 parameters part:3 particular passed performs permanent permissions:2 permit permitted place portions:2 present:2 problems produce "
        "produced:2 programs prominent:3 properly provide:3 provided:4 proxy:2 public:12 publish published:3 purpose received:3 recombine recombining reference "
        "refers:4 relink relinking remains reproducing required restrict reverse revised:2 run s:2 same:2 section:5 sections shall shared side:2 similar single "
        "small software:4 source:8 specified:2 specifies:2 specify spirit statement still structure subclass such:6 suitable:3 supplemented supplied supply "
        "system:2 taken templates ten terms:8 than:2 that:26 the:114 then these this:15 time:3 to:22 together:2 uncombined:2 under:10 use:6 used:3 user:3 "
        "uses:2 using utility verbatim version:27 versions:5 was well whatever when where whether which:2 will:2 with:16 without work:24 works would you:20 "
        "your:4 "
    ),
    "Apache-2.0": (
        "0:3 1:2 2:4 2004 3 4 5 50 6 7 8 9:2 a:22 above acceptance accepting:3 act acting acts add:2 addendum additional:5 additions advised against:2 agree "
        "agreed:3 agreement all:3 alleging alone along alongside also an:7 and:46 annotations any:30 apache:6 appear appendix:2 applicable:3 applies apply:2 "
        "appropriate appropriateness archives are:6 arising as:17 asserted associated assume at:2 attach attached attribution:4 authorized:2 authorship:3 "
        "available b based basis:2 be:5 been:2 behalf:5 below beneficial bind boilerplate brackets:2 but:5 by:23 c cannot carry cause:2 changed character "
        "charge:3 choose claim claims:2 class code:3 combination comment commercial common communication:3 compiled compliance complies computer conditions:13 "
        "configuration consequential consistent conspicuously constitutes construed contained content contents contract:2 contribution:8 contributions:3 "
        "contributor:10 contributory control:4 controlled conversions copies copy:3 copyright:13 counterclaim cross customary d damages:5 date defend defined "
        "definition:2 definitions deliberate derivative:18 derived describing description designated determining different direct:3 direction disclaimer "
        "discussing display:2 distribute:5 distributed:3 distribution:5 do:3 document documentation:3 does don each:4 easier editorial either:2 elaborations "
        "electronic:2 enclosed:2 end entities entity:10 even event example except:3 excluding:3 exclusive:2 executed exercise exercising explicitly express:2 "
        "failure fee fields fifty file:8 filed files:3 fitness following:3 for:24 form:13 format free:2 from:5 generated:2 give goodwill governing grant:3 "
        "granted:2 granting grants:2 grossly harmless has:2 have:2 hereby:2 herein hold how however http:2 i identification identifying if:6 ii iii implied:2 "
        "import improving in:24 inability incidental include:3 included:2 includes including:9 inclusion:2 incorporated:2 incurred indemnify indemnity "
        "indicated indirect:2 individual:3 information informational infringed infringement:2 institute intentionally:2 interfaces irrevocable:2 is:10 issue "
        "its:3 january kind:2 language law:3 lawsuit least legal:5 liability:5 liable licensable license:35 licensed licenses:3 licensor:10 limitation:2 "
        "limitations limited:4 link lists litigation:2 loss losses made:2 mailing make making malfunction managed management marked marks may:9 mean:10 means:2 "
        "mechanical media medium meet merchantability merely modifications:6 modified modify:2 modifying more must:4 name:3 names:2 necessarily negligence "
        "negligent no:4 non:3 normally not:12 nothing notice:9 notices:8 notwithstanding object:6 obligations:2 obtain of:67 offer:2 on:11 one only:4 or:69 "
        "org:2 origin original:2 other:7 otherwise:6 out outstanding own:4 owner:6 ownership:2 page part:4 particular party:2 patent:7 percent perform "
        "permission permissions:3 perpetual:2 pertain:2 places possibility power preferred prepare printed product prominent provide provided:5 provides:2 "
        "publicly:2 purpose:3 purposes:4 readable reason reasonable received recipients recommend redistributing:2 redistribution regarding remain replaced "
        "represent representatives reproduce:2 reproducing reproduction:4 required:4 responsibility responsible result resulting retain revisions rights risks "
        "royalty:2 s:3 same section sections see sell:2 sent separable separate service shall:15 shares should software:2 sole solely source:12 special "
        "specific state stated:2 statement stating stoppage subject:2 sublicense submission submit submitted:4 subsequently such:18 supersede support syntax "
        "systems:2 t terminate terms:9 text:4 that:22 the:100 their:2 then:2 theory thereof:4 third:2 this:17 those:3 through title to:40 tort tracking trade "
        "trademark trademarks:2 transfer transformation translation types under:9 union unless:4 use:10 using verbal version:3 warranties:3 warranty:4 was we "
        "where wherever whether:4 which:2 while whole:2 whom with:11 within:8 without:5 work:34 works:19 worldwide:2 writing:4 written www:2 you:26 your:13 "
        "yyyy "
    ),
    "MPL-2.0": (
        "0:6 1:30 10:8 11 12 13 14 2:27 3:22 30 4:7 5:9 50 6:3 60 7:3 8:2 9:2 a:55 ability able above:3 absence absolutely accurate actions add addition "
        "additional:5 additionally affect affero after:2 against:3 agree agreement agreements all:7 alleging allow alone also:3 alter:4 an:7 and:36 any:44 "
        "anyone apparatus applicable:2 application apply:2 are:5 as:12 asserting assume at:4 attached:3 attempt:2 authorized automatically available:3 b:12 "
        "back basis:4 be:18 become:3 been:2 behalf:2 believes beneficial bring brought business but:2 by:26 c can:3 case cause caused character charge:2 "
        "choice:2 choose:2 circumstances claim:2 claims:8 clear code:21 combination:3 combines come commercial common complete compliance:4 compliant:2 "
        "comply:6 computer concerning conditions:3 conflict consequential:2 constitutes construe construed contained contains contents contract:3 contribute "
        "contributes contribution:5 contributions:8 contributor:35 contributors control:2 controlled controls conveyed:2 copy:3 copyright:3 correction cost:2 "
        "counter:2 courts covered:36 create:5 creates creation:2 cross:2 damages:5 date:2 days:2 dealing death declaratory defective defects defendant defined "
        "definition definitions deletion describe described:3 description:2 desirable detailed different differs direct:2 direction directly directory "
        "disclaimer:3 disclaimers:2 display distinguishing distribute:9 distributed distributes:2 distributing distribution:6 distributions distributors:2 do:2 "
        "doctrines document does:2 drafter due:2 each:6 earlier effect effective:2 either:6 end enforceable entire entities entity:6 equivalents essential even "
        "event every except:7 excluding:2 exclusion:2 exclusive executable:7 exercising exhibit:5 explicitly exploit expressed extent:6 factual fail fails "
        "failure fair:3 fee fifty file:7 files finally first:2 fit following for:22 form:29 foundation free:2 from:9 further general:3 given gnu:3 goodwill "
        "governed:4 grant:6 granted:9 grants:6 has:5 have:6 having:2 held hereby:2 hereof how:2 however:2 http i if:17 ii implied:2 import:2 impossible in:30 "
        "inability inaccuracies incidental:2 include:2 included includes including:7 incompatible:6 incurred indemnify indemnity:3 indirect:2 indirectly "
        "individual:2 inform:2 informed infringed:2 infringement infringements infringes infringing initial:3 initiate injury intellectual intended into is:23 "
        "it:7 its:14 judgment judicial jurisdiction:3 jurisdictions kind known language larger:6 later law:3 laws legal:4 lesser liability:9 liable "
        "licensable:3 license:69 licenses:13 licensing likely limit:2 limitation:8 limitations:4 litigation:4 location logos look loss losses lost made:4 "
        "maintains make:4 makes making:2 malfunction management manner marks material matter maximum:2 may:16 means:18 merchantable method miscellaneous "
        "modification modifications:6 modified:3 modify:2 more:4 moreover mozilla:5 mpl:2 must:9 name necessary:3 negligence:2 new:5 no:8 non:5 not:17 note "
        "nothing notice:11 notices:6 notifies notify notwithstanding number obligation obligations obtain:3 of:115 offer:3 offered offering on:8 one:4 "
        "ongoing:2 only:4 option or:67 order ordinary org original originally other:8 others otherwise:4 outstanding own ownership:3 owns part:3 particular:6 "
        "party:4 patent:10 percent perform performance permits permitted:2 personal place placed portions possibility possible:3 power preferred prevent "
        "principal prior:3 process profits prohibited prohibits property prove provided:4 provides provision:2 provisionally provisions public:6 publish "
        "published purpose purposes put quality reasonable:3 receipt received:2 recipient:4 recipients:5 reference references reformed regulation:4 "
        "reinstated:2 relating relevant remedy remove:2 removed rename repair representation represents:2 reproduce required requirements:2 resellers respect:3 "
        "responsibilities restrict result:2 resulting results right:2 rights:14 risk royalty s:8 sale:2 scope secondary:12 section:11 sections:2 see sell "
        "selling separate service servicing shall:10 shares should skill so:3 software:39 some:4 source:20 special specific statute:3 statutory steward:4 "
        "stoppage subject:2 sublicense subsequent:3 subsequently substance such:32 sufficient sufficiently support:3 survive terminate:2 terminates "
        "termination:4 terms:20 text than:5 that:26 the:130 their then:5 theory thereof they:3 third this:49 those time:2 timely to:62 tort trademark "
        "trademarks transfer:2 under:35 understand unenforceable unless unmodified until use:6 used:2 user using v:2 validly version:17 versions:6 want "
        "warranties warranty:8 was:2 where:2 whether:3 which:5 who wide will:3 with:22 within without:5 work:11 world would:2 you:50 your:9 "
    ),
    "CC0-1.0": (
        "0 1:2 11 1996 2 3 4:2 9 96 a:18 abandoned abandons absence:2 account accuracy acknowledges action:4 adapt addition additional advertising:2 affected:2 "
        "affirmer:17 affirms against all:5 amended an:5 and:55 any:24 applicable:7 applied apply:2 are:2 arising as:9 assert associated:2 associating at "
        "attorney author authorship automatically available b based basis be:6 below:2 benefit build but:2 by:10 c can cancellation case:2 causes:3 cc0:7 "
        "certain claims:4 clearing client code commercial:3 commons:8 communicate compensation competition concerning confer consents consideration "
        "contemplated contrary contravention contribute contributing copies:2 copyright:11 corporation corresponding council create creative:7 creator "
        "cultural:2 culture current:2 d damages data database:2 databases date deemed defects defined depicted detriment directive:2 disclaimers disclaims:3 "
        "discoverable display disrupt dissemination distribute:2 distribution:2 document:5 does:2 duration:2 duty each:4 ec effect effective efforts either "
        "elects enjoyment equitable equivalent errors european exclusive:2 exercise:2 existing expectation express:4 extensions:2 extent:5 extraction fallback "
        "fear firm fitness following for:18 form free:2 freely from fully:2 further:2 future:5 gain grants greater greatest:2 has he:2 heirs held her:2 "
        "hereby:3 hereunder:2 his:2 i:4 ideal ii:4 iii:3 image implementation implementations implied in:21 include including:9 incorporate ineffective:2 "
        "ineffectiveness information:3 infringement:2 intended intending into invalid:2 invalidate invalidity irrevocable irrevocably is:6 its iv:3 judged:3 "
        "jurisdictions kind knowledge known large latent later law:8 laws legal:5 legally:2 liability license:6 licensed likeness limitation:5 limitations:2 "
        "limited made makes:3 march maximum:3 may:3 meaning medium:2 member merchantability modify moral most motivations national:2 necessary neighboring no:4 "
        "non:4 not:10 now number:2 obligation obtaining of:50 offers on:4 or:45 original:2 other:7 others otherwise:2 overtly owner:3 owners:2 paragraph "
        "parliament part:3 partial particular party patent perform performer permanently:2 permissible permissions permitted:2 person:4 persons pertaining "
        "possible present preserved privacy production promote promotional:2 protected protecting:2 protection provide provided:4 provides public:4 publicity "
        "publicly purpose:8 purposes:5 quiet reason:2 redistribute regarding regards related:11 relationship reliably relinquish remainder remaining "
        "representations reproduce reputation required rescission respect:2 responsibility:2 resulting retained reuse:2 revocation right rights:22 royalty s:11 "
        "scientific:2 services shall:4 she:2 should:2 similar so statement:4 statutory subject:2 sublicensable subsequent successor successors such:5 "
        "surrendered surrenders taking termination terms territories:2 that:6 the:66 their then thereof:3 these:2 this:7 those:3 through throughout:2 time:2 "
        "title to:29 trademark transferable translate treaty:3 unconditional unconditionally under:7 understands unfair universal unknown upon:2 use:7 v "
        "version vi vii voluntarily waived waiver:7 waives warranties:3 was well whatsoever:3 whether:2 will wish with:4 without:7 work:26 works:5 world:2 "
        "worldwide:2 "
    ),
    "BSD-3-Clause": (
        "1 2 3 a above:2 advised all and:9 any:4 are:3 arising as be:2 binary:2 business but:2 by caused code conditions:3 consequential contract "
        "contributors:3 copyright:2 damage damages data derived direct disclaimed disclaimer:2 distribution documentation endorse even event exemplary express "
        "fitness following:3 for:2 form forms from goods however if implied:2 in:6 incidental including:3 indirect interruption is:2 its liability:2 liable "
        "limited:2 list:2 loss materials may merchantability met modification must:2 name names negligence neither no nor not:2 notice:2 of:13 on or:11 other "
        "otherwise out particular permission permitted possibility prior procurement products profits promote provided:3 purpose redistribution "
        "redistributions:2 regents:2 reproduce reserved retain rights services shall software:3 source:2 special specific strict substitute such that the:15 "
        "theory this:5 to:3 tort university use:3 used warranties:2 way whether with:2 without:2 written "
    ),
    "BSD-2-Clause": (
        "a above:2 advised all and:9 any:4 are:3 arising as be binary:2 business but:2 by caused code conditions:3 consequential contract contributors:2 "
        "copyright:4 damage damages data direct disclaimed disclaimer:2 distribution documentation even event exemplary express fitness following:3 for:2 form "
        "forms goods holder holders however if implied:2 in:6 incidental including:3 indirect interruption is:2 liability:2 liable limited:2 list:2 loss "
        "materials merchantability met modification must:2 negligence no not:2 notice:2 of:11 on or:10 other otherwise out particular permitted possibility "
        "procurement profits provided:3 purpose redistribution redistributions:2 reproduce reserved retain rights services shall software:2 source:2 special "
        "strict substitute such that the:12 theory this:4 to:2 tort use:3 warranties:2 way whether with:2 without "
    ),
    "MIT": (
        "a:2 above action all an and:5 any:3 arising as associated authors be:2 but charge claim conditions connection contract copies:2 copy:2 copyright:2 "
        "damages deal dealings distribute do documentation event express files fitness following for:2 free from furnished granted hereby holders implied in:6 "
        "included including:2 is:4 kind liability liable license limitation limited merchantability merge mit:2 modify no noninfringement not notice:2 "
        "obtaining of:8 or:9 other:2 otherwise out particular permission:2 permit person persons portions provided publish purpose restriction rights sell "
        "shall:2 so software:9 subject sublicense substantial the:15 this:2 to:8 tort use:2 warranties warranty whether whom with without:3 "
    ),
    "GPL-1.0": (
        "0 02110:2 1:9 10 1301:2 1989:3 19xx 19yy 2:6 3 4 5 51:2 6 69 7 8 9 a:41 above:5 absence absolutely acceptance accompany:5 achieve act:2 add address "
        "addressed advised aggregation agreed agreement agreements all:12 allowed:2 alone along:2 also:5 alter alternative an:5 and:57 announcement another "
        "any:28 anyone appendix applicable:2 applies:3 apply appropriate:3 appropriately april are:4 arising as:11 ask:2 assemblers assume at:8 attach:2 "
        "attempt author:4 authors:2 automatically:2 away b:2 based:3 be:12 because been being below best boston:2 brief bring but:6 by:15 c:8 called can:7 "
        "carry cause:3 certain:3 change:4 changed changing charge:5 choose:2 clicks code:12 comes commands:3 commit companies:2 compilers complete:3 compliance "
        "concerns conditions:9 consequential conspicuously contact containing contains:3 contrast convey coon:2 copies:8 copy:16 copying:3 copyright:12 "
        "copyrighted correction corresponding:3 cost:2 could course d damages:3 data:2 date decision defective definitions deny derivative:2 derivatives "
        "designed detail details:3 develop differ different direct disclaimer:2 disclaims display distinguishing distribute:11 distributed:4 distributing "
        "distribution:6 do:5 document does:3 each:7 effectively either:6 electronic else:2 employer end entire even:3 event ever everyone:3 example except:4 "
        "exception exceptions exchange exclusion executable:4 exercise expressed expressly extent failure february fee:4 fifth:2 file:4 files:4 fitness:2 "
        "floor:2 follow following:4 for:34 forbid form:3 found foundation:9 franklin:2 free:23 freedom:3 from:3 full:2 further general:18 generally get:3 "
        "give:5 given gives gnomovision:3 gnu:5 goals grant granted gratis greatest guarantee guided hacker has have:8 header here hereby herein holder:3 "
        "holders hope how:3 however humanity hypothetical idea if:17 implied:3 impose in:17 inability inaccurate inc:3 incidental include including:4 "
        "incorporate independent indicate information:2 intact intended interactive:3 interactively interest into introduced is:26 it:31 items its:4 james "
        "keep:2 kind know:2 later:3 law:2 least:2 legal liable libraries license:26 licensed:2 licensee licenses licensor like limited:2 line:2 long loss "
        "losses ma:2 machine:2 mail make:9 making may:17 means:3 medium:2 menu merchantability:2 mercy mere mode modification:2 modifications:4 modified:3 "
        "modify:8 modifying modules:2 more most:3 mouse must:5 name:3 names necessary:2 need:2 new:6 no:7 nominal noncommercial normally not:13 notice:6 "
        "notices:3 number:3 object:2 obtained of:73 offer:3 on:10 one:2 only:2 operate operating:2 option:4 or:60 original:3 other:10 others otherwise:2 our:3 "
        "ours out output paper paragraph:2 paragraphs:3 part:2 particular:2 parties:6 parts:2 party:3 passed passes performance permission:2 permitted:3 "
        "physical:2 pieces placed pointer portion:3 possibility possible preamble precise preferred present preserving president price print problems:2 "
        "program:48 programmer programs:5 prominent promoting protect:2 protection:3 prove provide:2 provided:4 public:17 publish:3 published:3 purpose:2 "
        "quality readable:2 reads receive:3 received:4 receives recipient recipients:4 redistribute:6 refer referring refers reflect remain rendered repair "
        "reputations required responsibilities restrictions:3 reuse revised rights:9 risk run running runs s:5 safest sample saying:2 school scope see sell "
        "servicing share sharing short should:5 show:7 sign signature similar simplest so:4 software:27 some someone something sometimes source:11 speak "
        "special:2 specifically specifies specify spirit st standard:2 start started starts stated stating status steps storage street subject sublicense:2 "
        "such:8 suits sure:3 surrender sustained system:2 tell telling terminate terminated terms:16 than that:28 the:135 their:2 them:2 there:4 thereof "
        "these:8 they:3 things third:4 this:21 those three time:3 to:77 too:2 transfer:2 transferring:2 translate try two:2 ty:2 type:2 under:15 understands "
        "unless usa:2 use:9 useful user users:3 using usual valid verbatim:3 version:13 versions:2 vice view void volume w:3 want:4 warranties warranty:14 "
        "way:2 we:7 welcome what:2 whatever when:5 where:2 whether which:8 who:2 whole:2 whose:2 will:7 wish with:12 without:4 work:12 write:3 writing:2 "
        "written:2 years you:58 your:14 yoyodyne "
    ),
    "LGPL-2.0": (
        "0 02110:2 1:7 10 11 12 13 1301:2 14 15 16 1990 1991:2 2:12 2d 3 4 5 51:2 6:5 6a 7 8 9 a:108 able above:9 absence accept:2 acceptance access:4 "
        "accessors accompanies accompany:5 accompanying achieve achieved act:2 actions activities actual add:2 adding addition address addressed advised after "
        "aggregation agreed agreement:2 all:18 allegation allowed along:3 already:2 also:8 alter:2 alternatively among:2 an:11 analogous and:92 another:2 "
        "any:40 anyone anything:2 appeared applicable:2 application:9 applies:5 apply:7 appropriate appropriately april are:17 argument arising as:29 ask:2 "
        "associated assume:2 at:7 attach:2 attempt attention author:3 authorized authors:2 automatically:2 avoid away b:3 balance based:15 be:25 because:5 "
        "been:2 being:2 believed below benefit better between:2 binary blur blurred body boston:2 both:2 brief bring but:8 by:39 c:4 called:2 can:13 cannot:3 "
        "carry case cause:2 certain:4 change:8 changed changes:5 changing:2 charge:5 choice:2 choose circumstance circumstances claim claims:2 clear:2 close "
        "code:22 collection collective combined:4 companies compelled compilation compile compiled compiler complete:6 compliance:2 component components "
        "compute:2 concerns concluded conditions:12 consequence:3 consequential considered consistent conspicuously constantly constitute contact containing:5 "
        "contains:5 contents:2 contest:2 contradict contradiction contradicts contrast contributions control:2 conveniently convey coon:2 copies:9 copy:29 "
        "copying:4 copyright:14 copyrighted:2 correction corresponding:2 cost:2 could countries:3 court:2 covered:7 creates customarily customer d:2 damages:3 "
        "danger data:7 date debugging decide:2 decision defective defined:2 definition definitions:2 deny depends deprive derivative:12 derivatives derived:2 "
        "designated:4 designed:4 detail details develop developers:2 development did:2 differ difference different directing directly:2 disclaimer:2 disclaims "
        "displays distinction:2 distinguishing distribute:23 distributed:9 distributing:3 distribution:17 distributor do:11 document does:7 don donor during "
        "each:9 effect effectively:2 effort either:7 electronic else:2 employer end enforcing engineering ensure entire:2 entirely:3 equivalent:2 especially "
        "even:4 event:2 ever every everyone:4 example:3 except:2 exception:2 exceptions exchange excluded excluding exclusion excuse executable:11 "
        "executables:4 execution exercise:2 explaining explicit expressed expressly extend extent facilities:4 facility:4 fact failure faith fall:2 falls "
        "faster fee:3 fifth:2 file:5 files:6 finally find first fitness:2 floor:2 follow following:2 for:53 forbid form:6 former forming found foundation:9 "
        "franklin:2 free:32 freedom:5 frob from:17 full:3 function:6 functions:4 further gave general:22 generally generous geographical get:3 give:5 given:3 "
        "gives gnu:13 goals goes good gpl:2 granted grants gratis greatest guarantee guided hacker happen has:7 have:14 he header:2 held here hereby herein "
        "hereinafter holder:4 holders hope:2 how:3 however:6 idea identifiable if:38 implemented implied:3 impose:2 imposed in:45 inability inaccurate inc:3 "
        "incidental include:3 included including:5 incompatible incorporate incorporated incorporates independent:3 indicate indirectly individually induce "
        "information infringe infringement inline installation instead:3 intact integrity intended:5 intent:2 interchange interest interface interfaces into:4 "
        "introduced invalid invoked irreversible is:80 isolation issues it:53 its:9 itself:4 james judgment june keep kernel kind knobs know:3 language later:3 "
        "latter law:5 layouts lead least:2 legal:2 legally length less liable libraries:13 library:138 license:66 licensed:4 licensee:2 licensees licenses:5 "
        "licensor limitation:3 limited:3 line:2 lines link:5 linked:6 linking:3 long loss losses ma:2 machine:3 macros made:6 mail major make:10 making:3 many "
        "material materials:3 may:20 meaningful means:5 medium:3 meet merchantability:2 mere method might modification:5 modifications:4 modified:8 modify:10 "
        "modifying:3 modules more:2 most:4 must:21 name:2 names necessarily necessary:2 need:2 needed new:6 newer no:7 non:2 normally:2 not:45 note nothing "
        "notice:6 notices:6 number:3 numbered numerical object:10 obligations:2 obtain of:153 offer:4 offering:3 on:28 once one:4 only:5 operate operates "
        "operating:2 opt option:4 optional or:81 order ordinary:12 original:5 other:21 others otherwise:5 our:4 out output outside:2 own paper parameters "
        "part:6 particular:3 parties:7 parts party:3 passed:2 patent:5 patents:3 pay people performance performing performs permission:3 permissions permit:3 "
        "permitted:5 permitting pertinent physical pieces place:5 placed places plus:3 pointer portion:5 portions:3 possibility possible:2 practices preamble "
        "precise precisely preferred prepared present preserving:2 president prevent price problems:2 produce:2 program:13 programmer programs:9 prohibited "
        "prominent:3 promote:2 promoting property proprietary:2 protect protecting:2 protection:2 prove provide:2 provided:7 public:24 publish:2 published:3 "
        "purpose:6 quality quite random range rather:3 read readable:3 reason:2 reasonably receive:4 received:3 receives recipient recipients:4 recommend "
        "recompile recompiling redistribute:4 redistribution:2 refer:3 reference referring refers:2 reflect refrain regardless:2 regards:2 released reliance "
        "relink:2 remain remains rendered repair reproducing reputations required:3 requirement:2 requirements requires responsibilities responsible rest "
        "restricted:2 restrictions:4 reuse reverse revised right:2 rights:11 risk root roots:2 royalty running:2 runs s:6 safest same:7 sample satisfies "
        "satisfy:2 say saying school scope:3 scripts section:13 sections:8 see seen sense:2 sent separate:4 service servicing share:2 sharing:3 she should:4 "
        "show side:2 sign signature signed significant similar simply:2 simultaneously since single small:2 so:13 software:35 sole some:5 someone sometimes "
        "source:16 speak special:3 specially specified:2 specifies specify:2 spirit square:3 start stated states stating status:2 steps still:3 storage "
        "straightforwardly street:2 structure subject sublicense:2 subsection:2 subsequent such:18 supplied:2 supply:3 sure:4 surrender sustained system:6 t "
        "table:3 take ten term terminate terminated terms:26 textual than:6 that:77 the:322 their:2 them:7 themselves:2 then:8 there:3 therefore:4 these:17 "
        "they:9 things:3 third:4 this:69 thoroughly those:5 though:2 threatened three threshold through:3 thus:5 time:3 to:136 together:3 too:2 tool "
        "transferring transforming translate translated translation treats true:3 tweaking two:3 ty:2 uncombined:2 under:24 understands understood "
        "unenforceable unless:2 unrestricted:2 up usa:2 use:17 used:5 useful:2 user:7 users:2 uses:12 using:4 usually utility:3 valid validity verbatim:3 "
        "verify version:19 versions:2 vice void volume want:4 warranties warranty:10 was way we:15 weaker well:2 were what:5 whatever:2 when:7 where:2 "
        "whether:6 which:12 while:2 who:6 whole:6 whose:3 wide will:11 willing wish:5 with:34 without:6 work:57 works:7 would:3 write:3 writing:3 written:4 "
        "wrote year years you:87 your:17 yoyodyne "
    ),
    "MPL-1.1": (
        "0 1:43 10:3 101 11:2 12:5 13 1995:3 2:40 212:2 227:2 3:21 30 4:8 48:4 5:5 50 6:9 60:4 7:3 7202:2 8:9 9:2 a:77 able above:8 absence absolutely:2 "
        "accepted:2 account acquire acquired:2 action actions add addition:2 additional:2 admission affect after:4 against:6 agree:4 agreeable agreed agreement "
        "agreements all:13 alleging:2 allow:3 alone:3 already:2 also:3 alter alternative alternatively alters always america amount an:15 and:70 another any:59 "
        "anyone api apis apparatus appear applicable:5 application:4 applies apply:4 appropriate:2 archival archiving are:16 arising arrangement as:26 assert "
        "asserting associated assume at:7 attached attempt attorneys authorized automatically:2 availability available:13 aware b:15 basis:4 be:21 became "
        "becoming been:6 behalf:2 believes beneficial between beyond breach:2 business by:53 c:8 calculated california:3 can case:3 cause:2 caused:2 change "
        "changes character charge:2 chartered choice:3 choose:2 circumstances citizen claim:8 claims:10 clara clear:3 code:98 collateral combination:8 combines "
        "combining commercial:6 common communications community comparisons compilation complete compliance:2 comply:4 complying compressed computer:4 "
        "concerning conflict confusingly consequential:2 consistent consisting conspicuously constitute constitutes construed contact contain:2 containing "
        "contains:3 contents:3 continue contract:3 contracts contribute:3 contributes contributor:54 contributors:2 control:3 controlled controls convention "
        "conveyed:2 copies copy:3 copyright corporation correction cost costs:2 county court courts covered:42 create:5 created:4 creates creation:2 cure d:2 "
        "damages:6 data date:5 day days:4 de death decision declatory decompression deemed:2 defective defects defined definition:2 definitions delete:2 "
        "deleted deleting deletion:2 derivative derived describe:4 described:7 describes description:4 designate detail detailed determining developer:26 "
        "development device devices:2 differ:3 different:2 differential differs direct direction directly:5 directory disclaimer:3 disclosed display:2 "
        "dispose:2 disputes distinguishing distribute:8 distributed:4 distributes distribution:8 distributions distributor:2 distributors district do:6 "
        "document:2 documentation:4 documenting does drafter due:3 duplicate:2 each:6 effect:2 effective:3 either:9 electronic:5 end:3 enforceable ensuring "
        "entire entities entity:7 equitable essential even:2 event every:3 except:7 excluded excluding:3 exclusion:2 exclusive:2 executable:11 exercise "
        "exercising exhibit:10 expenses expiration express expressed expressly extent:6 f:4 fail:2 failure federal fee fees fifty file:17 files:3 filling "
        "first:3 fit for:34 form:5 forth:2 found free:3 from:16 fulfilled:2 future:3 generally given goods goodwill governed:6 governing government:2 grant:5 "
        "granted:12 grantor grants:2 had hardware has:9 have:6 having held hereafter hereby:4 herein:4 hereof hereunder:4 how however:2 https i:3 identified "
        "if:23 ii:3 implement implied:2 impose impossible in:60 inability incidental:2 include:8 included:3 includes including:10 incurred:2 indemnify:2 "
        "indemnity:3 indicate indirect:2 indirectly:5 individual:2 inform information informed infringed:3 infringement:3 infringements:2 infringes:3 "
        "infringing initial:27 initially initiate initiation injury installation instead intellectual:6 intended interface:2 international into is:37 issued "
        "it:12 item its:6 judgment judicial june jurisdiction jurisdictions kind:2 know knowledge:4 known language:2 larger:6 law:5 least:3 legal:7 liability:9 "
        "liable licensable:4 license:81 licensed:3 licenses:5 likely limit limitation:10 limitations:2 lists litigation:5 location look losing loss losses "
        "lying made:18 mailing maintained make:7 makes:2 making:5 malfunction management matter matters maximum:2 may:21 means:17 mechanism:5 media "
        "merchantable met method miscellaneous modification:7 modifications:27 modified modify:4 modules months:2 more:3 mozilla:6 mozillapl mozpl mpl:5 "
        "multiple:3 must:20 mutually:2 name:3 nations nature necessary:3 negligence:2 netscape:6 new:5 newsgroups no:7 non:3 northern not:21 note:2 nothing "
        "notice:18 notices:2 notifying notwithstanding:2 now npl number obligation obligations:3 obtain obtained obtains oct of:158 offer:6 offered:2 offering "
        "on:11 once one:4 only:7 or:123 order:2 ordinary org origin original:24 other:15 others otherwise:7 out outstanding own owned ownership:5 part:5 "
        "participant:14 particular:5 parties:2 party:13 past patent:16 patents pay payment:2 percent perform:2 performance period permits person personal "
        "phrase phrases plus portions:11 possibility possible:3 power practice preferred previous:3 prior:3 process product programming prohibited prohibits "
        "prominent promptly properly property:6 prospectively prove provided:4 provides:2 provision:2 provisions:7 public:5 publish published:2 purpose "
        "purposes pursuant put quality r:4 rather reasonable:4 reasonably:2 receipt received recipient:4 recipients:5 referred reformed registered regulation:4 "
        "related:3 relating:3 release released:2 relevant remain:2 remains rename repair replace representations represents:2 reproduce:2 required:5 "
        "requirements:2 resellers reserved resolved respect:4 responsibility:2 responsible:3 restricts result:2 resulting revised revoked right:2 rights:24 "
        "risk royalty:4 s:16 sale:3 same santa scripts section:12 sections:7 see sell:2 selling:2 separate:2 sept series servicing set:2 settlement shall:17 "
        "shares should:2 similar single six skill slightly so:3 software:9 sold some:2 source:24 special specific specified:2 statement states stating "
        "statute:3 steps stoppage structure:2 subject:5 sublicense:2 sublicenses subsequent:2 subsequently substance such:41 sufficient:2 sufficiently supplier "
        "support:3 sure survive:3 take taken term terminate:3 termination:6 terms:24 text:5 than:8 that:37 the:229 their them themselves then:5 theory "
        "thereafter thereof:6 they third:7 this:58 those:3 through time:4 titled to:95 tort trademark:2 transfer twelve u:2 under:39 understand unenforceable "
        "united:2 unless unmodified upon:2 use:16 used:5 user:2 users:2 using:2 utilization utilize validly value:2 venue version:39 versions:5 via:2 "
        "warranties warranty:7 well when where:4 whether:3 which:25 who whom:3 wide:2 widely will:3 wish with:28 withdraw withdrawn within:3 without:8 work:8 "
        "works:2 world:2 would writing:2 www you:74 your:16 "
    ),
    "0BSD": (
        "action:2 all:2 an and:3 any:3 arising as author:2 be c com connection consequential contract copy copyright damages:2 data direct disclaims distribute "
        "event fee fitness for:2 from gmail granted hereby implied in:3 including indirect is:3 jonas jonasschievink liable loss merchantability modify "
        "negligence no of:5 or:8 other out performance permission profits provided purpose regard resulting schievink shall software:4 special the:4 this:3 "
        "to:2 tortious use:3 warranties:2 whatsoever whether with:3 without "
    ),
    "ISC": (
        "above action:2 all:3 an and:4 any:3 apache appear arising as author:2 be connection consequential contract copies copy copyright damages:2 data direct "
        "disclaims distribute event fee fitness for:2 from granted hereby implied in:4 including indirect is:3 isc liable license:2 loss merchantability modify "
        "negligence no notice:2 of:5 or:8 other out performance permission:2 profits provided:2 purpose regard resulting shall software:4 special that the:6 "
        "this:4 to:2 tortious use:3 warranties:2 whatsoever whether with:3 without "
    ),
    "Unlicense": (
        "a:2 act action all:2 an:2 and:7 any:5 anyone arising as:2 at author authors:2 be:2 benefit binary but by claim code commercial:2 compile compiled "
        "connection contract copy copyright:3 damages dealings dedicate dedication:2 detriment distribute domain:2 either event express fitness for:5 form "
        "free:2 from future heirs http implied in:8 including information intend interest into is:4 jurisdictions kind large law laws liability liable limited "
        "make means merchantability modify more no non noninfringement not of:9 or:10 org other:2 otherwise our out overt particular perpetuity please present "
        "provided public:3 publish purpose:2 recognize refer released relinquishment rights sell shall software:8 source successors that the:13 this:6 to:7 "
        "tort under unencumbered unlicense use:2 warranties warranty we:2 whether with without "
    ),
    "EPL-1.0": (
        "0 1:2 2:4 3 4 5 6 7 a:39 above accept acceptance accompanying accordance acquire acting action:3 actions acts actual added:2 addition:2 additions:3 "
        "advised affect after:3 against:4 agreement:40 agrees:2 all:9 alleged alleging allow:2 allows alone:3 alter although always america an:2 and:50 any:37 "
        "anyone:2 applicable:2 apply:3 appropriateness are:8 arising:2 arose as:12 assign associated assumes:2 assurances at:2 available:3 avoid aware b:7 "
        "based basis be:7 becoming before behalf:3 bring brought:2 business but:2 by:16 c case:2 cause caused:2 causes cease certain changes:2 choose claim:3 "
        "claims:8 code:8 collectively combination:2 combinations:2 combined commercial:17 compliance complies comply condition conditions:7 conjunction "
        "connection consequential:2 constitutes contained continue contract contribution:12 contributions:5 contributor:44 contributors:7 control cooperate "
        "copies copy:3 copyright:4 copyrighted costs:2 counterclaim court covered create cross cure customarily d damage damages:7 data date defend:2 defense "
        "definitions derivative:3 determining differ direct:2 disclaimer disclaims:2 display distinguishing distribute:5 distributed:5 distributes "
        "distributing:2 distribution:5 distributors do:3 documentation does:3 each:12 eclipse:4 effectively:2 either elect end enforceability enforceable "
        "entity:5 equipment errors estoppel even every everyone example:2 except:3 exchange excludes excluding exclusive:2 exemplary exercise:2 exercising "
        "expense express:2 expressly:5 extent:2 facilitate fails failure filed fitness:2 following for:11 form:4 forth:4 foundation:2 free:2 from:6 further "
        "general given governed grant:2 granted:5 grants:3 hardware:2 has:2 have:2 hereby:4 herein hereto hereunder:3 how however:2 i:3 identify:2 if:16 ii:3 "
        "iii implication implied:3 import in:35 incidental:2 include:3 included includes:2 including:11 inconsistency indemnified:4 indemnify indirect:2 "
        "informs infringe infringed infringement:4 infringes initial:3 institutes intellectual:6 intended interruption invalid is:19 it:9 its:12 itself:3 iv "
        "jury kind knowledge law laws:3 lawsuit lawsuits legal:2 liability:7 licensable license:13 licensed:4 licensees licenses:4 like limitation:2 limited "
        "litigation:3 loss losses:3 lost:2 made:2 make:2 makes manner:4 material may:8 mean means:4 medium merchantability:2 might minimum modified modify "
        "modules more must:5 necessarily necessary needed negligence negotiations neither new:5 no:6 non:4 noncompliance nor not:12 notices notify number "
        "object:3 obligations:2 obtain of:68 offer offered offering:4 offers omissions on:7 one:2 only operations or:35 order:2 originate originates "
        "originator:2 other:13 otherwise:4 out own:3 participate particular:3 parties partners party:5 patent:8 patents:3 pay:2 per perform performance:3 "
        "period permitted person possibility potential practicable prepare product:6 profits:2 program:38 programs promptly property:6 provided:4 provision:3 "
        "provisions public:2 publicly:2 publish published purpose:2 qualify reasonable:2 reasonably:2 received receives:2 recipient:20 recipients reformed "
        "related:3 relating:2 remainder remove represents reproduce reproduction required requirements requires reserved reserves respect responsibilities "
        "responsibility:4 responsible result resulting revisions right:2 rights:14 risks:2 royalty:2 s:10 sale se section:3 sections secure sell:2 separate:2 "
        "serve set:4 settlement shall:8 should so software:4 sole solely soon source:4 special:2 state stated states:3 steward:4 strict subject:3 sublicense "
        "subsequent:2 such:23 sufficient suitable survive terminate:3 terms:6 than:2 that:14 the:113 their then:3 theory therefore third:2 this:33 those:3 "
        "through time:4 title:2 to:56 tort transfer trial unavailability under:19 understands unenforceable united use:6 used users using v valid validity "
        "version:5 versions waives warranties:8 warranty was:2 way when:2 where whether:2 which:6 while who:2 will:2 with:12 within without:4 works:3 "
        "worldwide:2 would writing x:2 year york "
    ),
}
