"""Further signatures, in the notation of signatures.py; `@offset in[x-y]` are the bytes of a range, `in[x-y,z]` of several.

They are the formats beyond the common ones: rarer images, code, databases, subtitles and settings, and binaries
whose headers need ranges of values.
"""

from __future__ import annotations

# Format, class and signature.
FURTHER = r"""
4xm media @0 'RIFF' @8 '4XMVLIST' @20 'HEADLIST' @32 'HNFO'
rmmp media @0 'RIFF' @8 'RMMPcftc' @20 '\x00\x00\x00\x00cftc' @32 '\x00\x00\x00\x00\x0c\x00\x00\x00'
av1 video @0 '\x12\x00\x0a' @3 in[\x04-\x7f]
theora video @0 '\x80theora' @7 in[\x00-\x07]
daala video @0 '\x80daala' @7 in[\x00-\x07]
swf vector @0 in{'FWS','CWS','ZWS'} @3 in[\x01-\x27]
cgm vector @0 in{'B','b'} @1 in{'E','e'} @2 in{'G','g'} @3 in{'M','m'} @4 in{'F','f'} @5 in{' ','"','\'','\x0a','\x0d'}
cgm vector @0 '\x00?\x00'
cgm vector @0 '0 ~>~'
cgm vector @0 '0 \x1b\x5c\x01b'
xara vector @0 'XARA\xa3\xa3\x0d\x0a\x02\x00\x00\x00' @13 in[\x00-\x03] @14 '\x00\x00' @16 in{'CXW','CXN'} @23 '\x00\x00\x00\x00'
cdr-old vector @0 'WLm\x00'
cdr vector @0 'RIFF' @8 in{'CDR','cdr'} @11 in{'4','5','6','7','8','9','A','B','C','D'} @12 'vrsn' @17 '\x00\x00\x00'
corelshow vector @0 'RIFF' @8 'shv4LIST'
autodesk-dwg vector @0 'AC10' @4 in{'12','14','15','18','21','24','27','32'} @6 '\x00\x00\x00\x00\x00' @12 '\x01'
jpc image @0 '\xffO\xffQ\x00' @5 in{')',',','/','2','5','8',';','>','A','D'}
xwd image @0 '\x00\x00' @2 in[\x00-\x01] @4 '\x00\x00\x00\x06' @8 '\x00\x00\x00' @11 in[\x00-\x10] @12 '\x00\x00\x00' @15 in[\x01-\x05] @16 '\x00\x00\x00' @19 in[\x00-\x01]
xwd image @0 '\x00\x00' @2 in[\x00-\x01] @4 '\x00\x00\x00\x07' @8 '\x00\x00\x00' @11 in[\x00-\x02] @12 '\x00\x00\x00' @15 in[\x01-\x20]
xwd image @1 in[\x00-\x01] @2 '\x00\x00' @4 '\x06\x00\x00\x00' @8 in[\x00-\x10] @9 '\x00\x00\x00' @12 in[\x01-\x05] @13 '\x00\x00\x00' @16 in[\x00-\x01] @17 '\x00\x00\x00'
xwd image @1 in[\x00-\x01] @2 '\x00\x00' @4 '\x07\x00\x00\x00' @8 in[\x00-\x02] @9 '\x00\x00\x00' @12 in[\x01-\x20] @13 '\x00\x00\x00'
dib image @0 '\x0c\x00\x00\x00' @8 '\x01\x00' @10 in{'\x01','\x02','\x04','\x08','\x18'} @11 '\x00'
rdib image @0 'RIFF' @8 'RDIBBM'
rdib image @0 'RIFF' @8 'RDIBdata'
lbm image @0 'FORM' @8 in{'ILBM','PBM ','RGB8','RGBN','ACBM','VDAT'} @12 'BMHD\x00\x00\x00\x14'
pcx image @0 '\x0a' @1 in[\x00,\x02-\x05] @2 in[\x00-\x01] @3 in{'\x01','\x02','\x04','\x08'}
ico image @0 '\x00\x00\x01\x00' @4 in[\x01-\x40] @5 '\x00' @9 in[\x00-\x01,\xff] @10 in[\x00-\x04] @11 '\x00' @12 in{'\x00','\x01','\x02','\x04','\x08','\x10','\x18',' '} @13 '\x00'
cur image @0 '\x00\x00\x02\x00' @4 in[\x01-\x40] @5 '\x00' @9 in[\x00-\x01,\xff] @11 '\x00' @13 '\x00'
ftc image @0 'FTC\x00\x01\x01\x02\x01'
deep image @0 'FORM' @8 'DEEPDGBL\x00\x00\x00\x08'
flif image @0 'FLIF' @4 in{'1','3','4','A','C','D','Q','S','T','a','c','d'} @5 in{'0','1','2'}
fuif image @0 in{'FUIF','FUAF'} @4 in[1-5] @5 in['-5]
xcf image @0 'gimp xcf ' @9 in{'file','v001','v002','v003','v004','v005','v006','v007','v008','v009'}
psp image @0 'Paint Shop Pro Image File\x0a\x1a\x00\x00\x00\x00\x00'
gem image @0 in{'\x00\x01\x00\x08\x00\x01\x00\x02','\x00\x01\x00\x08\x00\x02\x00\x02','\x00\x01\x00\x08\x00\x04\x00\x02','\x00\x01\x00\x08\x00\x08\x00\x02','\x00\x01\x00\x09\x00\x01\x00\x02','\x00\x01\x00\x09\x00\x02\x00\x02','\x00\x01\x00\x09\x00\x04\x00\x02','\x00\x01\x00\x09\x00\x08\x00\x02','\x00\x01\x00\x0a\x00\x01\x00\x02','\x00\x01\x00\x0c\x00\x02\x00\x02','\x00\x01\x00\x18\x00\x04\x00\x02','\x00\x01\x01\x08\x00\x08\x00\x02'}
gem image @0 in{'\x00\x01\x00\x0b\x00\x01\x00\x02','\x00\x01\x00\x0d\x00\x02\x00\x02','\x00\x01\x00\x19\x00\x04\x00\x02','\x00\x01\x01\x09\x00\x08\x00\x02'} @16 '\x00\x80'
gem image @0 in{'\x00\x01\x00\x0d\x00\x01\x00\x01','\x00\x01\x00\x0f\x00\x02\x00\x01','\x00\x01\x00\x1b\x00\x04\x00\x01','\x00\x01\x01\x0b\x00\x08\x00\x01'} @16 'STTT\x00\x10'
gem image @0 in{'\x00\x02\x00\x11\x00\x01\x00\x01','\x00\x02\x00\x17\x00\x02\x00\x01','\x00\x02\x00;\x00\x04\x00\x01','\x00\x02\x03\x0b\x00\x08\x00\x01'} @16 'XIMG\x00\x00'
pcpaint-pic image @0 '4\x12' @6 '\x00\x00\x00\x00' @11 in{'\xff','1','2','3'} @13 in[\x00-\x04]
minolta-raw image @0 '\x00MRM\x00' @6 in[\x00-\x03] @8 '\x00PRD\x00\x00\x00\x18'
dpx image @0 'SDPX\x00\x00' @8 'V' @9 in{'1','2'} @10 '.' @11 in[0-9]
vicar image @0 'LBLSIZE=' @8 in[1-9] @9 in[0-9]
pds image @1 '\x00NJPL1I00PDS'
pds image @1 '\x00PDS_VERSION_ID' @16 in{'\x09','\x0a','\x0b','\x0c','\x0d',' '}
pds image @1 '\x00CCSD3ZF'
utah-rle image @0 'R\xcc' @10 in[\x00-\x0f] @11 in[\x01-\x05] @12 '\x08' @13 in[\x00-\x05] @14 in[\x00-\x08]
utah-rle image @0 'R\xcc\x00\x00\x00\x00' @10 in[\x00-\x0f] @11 in[\x01-\x05] @12 '\x08' @13 in[\x00-\x05] @14 in[\x00-\x08]
xv-pm image @0 'VIEW\x00\x00\x00' @7 in{'\x01','\x03','\x04'} @16 '\x00\x00\x00\x01\x00\x00\x80' @23 in{'\x01','\x04'}
xv-pm image @0 'WEIV' @4 in{'\x01','\x03','\x04'} @5 '\x00\x00\x00' @16 '\x01\x00\x00\x00' @20 in{'\x01','\x04'} @21 '\x80\x00\x00'
brender-pix image @0 '\x00\x00\x00\x12\x00\x00\x00\x08\x00\x00\x00\x02\x00\x00\x00\x02'
photocd image @0 '\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff'
sun-taac image @0 'ncaa' @4 in[\x0d,\x0a,a-z] @5 in[\x0d,\x0a,a-z]
fit image @0 'IT0' @3 in{'1','2'} @12 '\x00\x00\x00' @15 in[\x01-\x20]
corel-bmf image @0 '@CorelBMF\x0a\x0dCorel Corporation\x0a\x0d'
shkarin-bmf image @0 '\x81\x8a' @2 in{'1','2'} @10 '\x00\x00\x00\x00' @18 '\x00\x00'
g3-digifax image @1 'PC Research, Inc'
g3-dumbpc image @0 'II*'
vorbis audio @0 '\x01vorbis\x00\x00\x00\x00' @11 in[\x01-\x0f]
opus audio @0 'OpusHead' @8 in[\x01-\x0f]
impulsetracker audio @0 'IMPM'
texinfo doc @0 '@ifnottex' @9 in{'\x0d','\x0a',' ','\x09'}
texmacs doc @0 '<TeXmacs|' @9 in{'1','2','3'} @10 '0'
texmacs doc @0 '(document (TeXmacs'
texmacs doc @0 'TeXmacs'
texmacs doc @0 '\x5c(\x5c)(TeXmacs'
chm doc @0 'ITSF\x03\x00\x00\x00' @9 '\x00\x00\x00\x01\x00\x00\x00' @22 '\x00\x00\x10\xfd\x01\x7c\xaa\x7b\xd0\x11\x9e\x0c\x00\xa0\xc9\x22\xe6\xec\x11\xfd\x01\x7c\xaa\x7b\xd0\x11\x9e\x0c\x00\xa0\xc9\x22\xe6\xec'
zoo archive @0 'ZOO ' @4 in{'1','2'} @5 '.' @6 in[0-9] @7 in[0-9] @8 ' Archive.\x1a\x00\x00\xdc\xa7\xc4\xfd'
uc2 archive @0 'UC2\x1a'
arj archive @0 '`\xea' @5 in[\x01-\x0f] @6 in[\x01-\x0f] @7 in[\x00-\x0f] @9 in[\x00-\x04] @10 in[\x00-\x04]
lha archive @2 in{'-lh0-','-lzs-','-lh1-','-lh2-','-lh3-','-lh4-','-lh5-','-lh6-','-lh7-','-lh8-','-lh9-','-lhd-','-lha-','-lhb-','-lhc-','-lhe-','-lhx-','-pc1-','-pm0-','-pm1-','-pm2-','-pms-','-lz2-','-lz3-','-lz4-','-lz5-','-lz7-','-lz8-'} @20 in{'\x00','\x01','\x02'}
arcx archive @0 'ARCX'
ain archive @0 '!' @1 in{'\x11','\x12'} @2 '\x00\x00\x00\x00\x00\x00'
binhex compress @0 '(This file must be converted with BinHex 4.0)'
binhex compress @0 '(This file must be converted with BinHex.Hex)'
binhex compress @0 '(This file must be converted with BinHex'
binhex compress @0 '(This file '
binhex compress @0 '(Convert with'
flate compress @0 in{'\x08','\x18','(','8','H','X','h'} @1 in{'\x01','^','\x9c','\xda'}
compact compress @0 in{'\x1f\xff','\xff\x1f'}
freeze compress @0 in{'\x1f\x9e','\x1f\x9f'}
crunch compress @0 'v\xfe'
squeeze compress @0 'v\xff'
crlzh compress @0 'v\xfd'
sco-lzh compress @0 '\x1f\xa0'
msdos-compress-szdd-qbasic compress @0 'SZ \x88\xf0\x273\xd1'
msdos-compress-kwaj compress @0 'KWAJ\x88\xf0\x27\xd1'
squash compress @0 'SQSH'
diet compress @0 '\xb4L\xcd!\x9d\x89dlz'
upxz compress @0 'UPXZ'
go-object code @0 'go object '
parrot-pbc code @0 '\xfePBC\x0d\x0a\x1a\x0a'
ruby-yarv code @0 '["YARVInstructionSequence/SimpleDataFormat", ' @45 in{'1','2','3','4'}
micropython-mpy code @0 'M' @1 in[\x00-\x03] @2 in[\x00-\x03] @3 in{'\x1e','\x1f','/','>','?'}
micropython-mpy code @0 'M' @1 in[\x04-\x1d] @2 in[\x00-\x7f] @3 in{'\x1e','\x1f','/','>','?'} @4 ' '
emacs-elc code @0 ';ELC' @4 in{'\x12','\x13','\x14','\x17'} @5 '\x00\x00\x00\x0a'
emacs-pdump code @0 'DUMPEDGNUEMACS\x00\x00'
clisp-bytecode code @0 '(SYSTEM::VERSION '
clisp-bytecode code @0 '(|SYSTEM|::|VERSION| '
dalvik-dex code @0 'dex\x0a0' @5 in{'45','44','43','42','41','40','39','38','37','35','13','09'} @7 '\x00'
common-lisp code @0 '(defun '
scheme code @0 '(define ('
quakec-lnof code @0 'LNOF\x01\x00\x00\x00'
ethereum-evm code @0 '`\x80`@R4\x80\x15a'
ethereum-evm code @0 '`\x80`@R`\x046\x10`' @11 'W`\x005'
ethereum-evm code @0 '`\x80`@R`\x046\x10a' @12 'W`\x005'
ethereum-evm code @0 '`\x80`@R`\x046\x10b' @13 'W`\x005'
ethereum-evm code @0 '`\x046\x10\x15`\x0cW`' @10 'V[`\x005'
ethereum-evm code @0 '`\x046\x10\x15a\x00\x0dWa' @12 'V[`\x005'
ethereum-evm code @0 '`\x046\x10\x15a\x00\x0dWb' @13 'V[`\x005'
ethereum-evm code @0 '`\x046\x10\x15b\x00\x00\x0dWb' @14 'V[`\x005'
ethereum-bzzhash code @0 'bzzr0X '
nekovm-bytecode code @0 'NEKO' @7 '\x00' @11 '\x00'
scumm-bytecode code @0 'LECF' @8 'LOFF'
scumm-bytecode code @0 '%,*/' @8 '%&//'
scumm-bytecode code @0 '\xb3\xba\xbc\xb9' @8 '\xb3\xb0\xb9\xb9'
scumm-index code @0 'RNAM\x00\x00\x00\x09\x00MAXS'
scumm-index code @0 ';\'($iii`i$(1:'
scumm-index code @0 '\xad\xb1\xbe\xb2\xff\xff\xff\xf6\xff\xb2\xbe\xa7\xac'
ocaml-bytecode code @0 'T\x00\x00\x00' @6 '\x00\x00'
ocaml-bytecode code @0 '\x00\x00\x00T\x00\x00'
com32r code @0 '\xb8\xfeL\xcd!'
com4mail code @0 'BEGIN===tfud#of_Com4Mail_file#\x0d\x0a'
rdoff code @0 'RDOFF' @5 in{'1','2'}
tclpro-bytecode code @0 'TclPro ByteCode '
tcl-bytecode code @0 'literals {'
macho code @0 in{'\xce\xfa\xed\xfe','\xcf\xfa\xed\xfe'} @4 in[\x01-\x16] @5 '\x00\x00' @7 in[\x00-\x01] @12 in[\x01-\x0f] @13 '\x00\x00\x00'
macho code @0 in{'\xfe\xed\xfa\xce','\xfe\xed\xfa\xcf'} @4 in[\x00-\x01] @5 '\x00\x00' @7 in[\x01-\x16] @12 '\x00\x00\x00' @15 in[\x01-\x0f]
macho code @0 '\xbe\xba\xfe\xca' @4 in[\x01-\x1e] @5 '\x00\x00\x00'
macho code @0 '\xca\xfe\xba\xbe\x00\x00\x00' @7 in[\x01-\x1e]
pef code @0 'Joy!peff' @8 in{'pwpc','m68k'} @12 '\x00\x00\x00\x01' @32 '\x00' @33 in[\x01-\x20] @34 '\x00' @35 in[\x01-\x20]
elf code @0 '\x7fELF' @4 in[\x01-\x02] @5 '\x01' @6 '\x01' @7 in[\x00-\x1f] @19 '\x00' @20 '\x01\x00\x00\x00'
elf code @0 '\x7fELF' @4 in[\x01-\x02] @5 '\x02' @6 '\x01' @7 in[\x00-\x1f] @18 '\x00' @20 '\x00\x00\x00\x01'
lua-luac code @0 '\x1bLua' @4 in{'$','%'} @5 '\x02\x04' @7 in{'\x04','\x08'} @8 in{'\x124','4\x12'}
lua-luac code @0 '\x1bLua' @4 '1' @5 in{'l','f','d','?'} @6 in{'\x04','\x08'}
lua-luac code @0 '\x1bLua' @4 '2' @5 in{'\x00','\x04','\x08'}
lua-luac code @0 '\x1bLua' @4 '@' @5 in[\x00-\x01] @6 in{'\x04','\x08'} @7 in{'\x04','\x08'} @8 in{'\x04','\x08'} @9 ' \x06\x09'
lua-luac code @0 '\x1bLua' @4 'P' @5 in[\x00-\x01] @6 in{'\x04','\x08'} @7 in{'\x04','\x08'} @8 in{'\x04','\x08'} @9 '\x06\x08\x09\x09' @13 in{'\x04','\x08'}
?-zeros8 other @0 '\x00\x00\x00\x00\x00\x00\x00\x00'
?-zeros16 other @0 '\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00'
jbf other @0 'JASC BROWS FILE\x00'
avidemux-mpeg-index other @0 'ADMY'
avidemux-project other @0 '//AD'
deadjoe other @0 '\x0a*** ' @5 in{'These modified','JOE was aborte','Modified files'}
mediafileinfo other @0 'format='
cue other @0 'REM COMMENT '
cue other @0 'PERFORMER '
cue other @0 'TITLE '
cue other @0 'FILE '
cue other @0 '\xef\xbb\xbfREM GENRE '
cue other @0 '\xef\xbb\xbfREM DATE '
cue other @0 '\xef\xbb\xbfREM DISCID '
cue other @0 '\xef\xbb\xbfREM COMMENT '
cue other @0 '\xef\xbb\xbfPERFORMER '
cue other @0 '\xef\xbb\xbfTITLE '
cue other @0 '\xef\xbb\xbfFILE '
pif other @0 '\x00' @30 '  ' @369 'MICROSOFT PIFEX\x00\x87\x01\x00\x00'
desktopini other @0 '\x0d\x0a[.ShellClassInfo]' @19 in{'\x0d','\x0a'}
desktopini other @0 '\x0d\x0a[LocalizedFileNames]' @22 in{'\x0d','\x0a'}
desktopini other @0 '\xff\xfe\x0d\x00\x0a\x00[\x00.\x00S\x00h\x00e\x00l\x00l\x00C\x00l\x00a\x00s\x00s\x00I\x00n\x00f\x00o\x00]\x00' @40 in{'\x0d','\x0a'}
desktopini other @0 '\xff\xfe\x0d\x00\x0a\x00[\x00L\x00o\x00c\x00a\x00l\x00i\x00z\x00e\x00d\x00F\x00i\x00l\x00e\x00N\x00a\x00m\x00e\x00s\x00]\x00' @46 in{'\x0d','\x0a'}
vobsub-idx other @0 '# VobSub index file, v'
srt other @0 in{'0','1'} @1 '\x0d\x0a00:' @6 in[0-9] @7 in[0-9] @8 ':'
srt other @0 in{'0','1'} @1 '\x0a00:' @5 in[0-9] @6 in[0-9] @7 ':'
sqlite2 database @0 '** This file contains an SQLite 2.' @34 in{'0','1'} @35 ' database **\x00' @48 in{'\xda\xe3u(','(u\xe3\xda'}
sqlite3 database @0 'SQLite format 3\x00' @16 in{'\x00\x01','\x02\x00','\x04\x00','\x08\x00','\x10\x00',' \x00','@\x00','\x80\x00'} @18 in[\x01-\x04] @19 in[\x01-\x04]
sqlite3-wal database @0 '7\x7f\x06' @3 in[\x82-\x83] @4 '\x00-\xe2\x18' @8 in{'\x00\x00\x02\x00','\x00\x00\x04\x00','\x00\x00\x08\x00','\x00\x00\x10\x00','\x00\x00 \x00','\x00\x00@\x00','\x00\x00\x80\x00','\x00\x01\x00\x00'}
lmdb-data database @0 in{'\x00\x00\x00\x00\x00\x00\x00\x08\x00\x00\x00\x00\xbe\xef\xc0\xde\x00\x00\x00\x01','\x00\x00\x00\x00\x00\x00\x08\x00\x00\x00\x00\x00\xde\xc0\xef\xbe\x01\x00\x00\x00'}
mdbx-data database @0 '\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x08\x00\x00\x00\x00\x00\x00\x00\x00\x00' @20 in[\x01-\x06] @21 '\x11L\xef\xbd\x9deY'
mdbx-data database @0 '\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x08\x00\x00\x00\x00\x00\x00\x00\x00Ye\x9d\xbd\xefL\x11' @27 in[\x01-\x06]
mdbx-lock database @0 in[\x01-\x06] @1 '\x11L\xef\xbd\x9deY'
mdbx-lock database @0 'Ye\x9d\xbd\xefL\x11' @7 in[\x01-\x06]
rdata database @0 in{'RDX2\x0aX\x0a','RDX3\x0aX\x0a','RDA2\x0aA\x0a','RDA2\x0aB\x0a','RDX2\x0aB\x0a'}
rds database @0 'X\x0a\x00\x00\x00' @5 in[\x02-\x03] @6 '\x00' @7 in[\x01-\x06]
qdbm database @0 in{'[DEPOT]\x0a\x0c\x00\x00\x00','[depot]\x0a\x0c\x00\x00\x00'} @12 in{'1\x00\x00\x00','2\x00\x00\x00','3\x00\x00\x00','4\x00\x00\x00','5\x00\x00\x00','6\x00\x00\x00','7\x00\x00\x00','8\x00\x00\x00','9\x00\x00\x00','10\x00\x00','11\x00\x00','12\x00\x00','13\x00\x00','14\x00\x00'}
ndbm database @0 in{'\x13W\x9a\xcd','\x13W\x9a\xce','\x13W\x9a\xcf','\xcd\x9aW\x13','\xce\x9aW\x13','\xcf\x9aW\x13'}
gdbm-numsync database @0 in{'\x13W\x9a\xd0','\x13W\x9a\xd1','\xd0\x9aW\x13','\xd1\x9aW\x13'}
gdbm-export-ascii database @0 '# GDBM dump file created by '
gdbm-export-binary database @0 '!\x0d\x0a! GDBM FLAT FILE DUMP -- THIS IS NOT A TEXT FILE\x0d\x0a! '
berkeleydb database @0 '\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00\x01' @12 in{'\x00\x04\x09\x88','\x00\x051b','\x00\x06\x15a','\x00\x07E\x82','\x00\x04"S'} @16 '\x00\x00\x00'
berkeleydb database @0 '\x00\x00\x00\x00\x01\x00\x00\x00\x00\x00\x00\x00' @12 in{'\x88\x09\x04\x00','b1\x05\x00','a\x15\x06\x00','\x82E\x07\x00','S"\x04\x00'} @17 '\x00\x00\x00'
berkeleydb-export database @0 'VERSION=' @8 in{'2','3','4','5'} @9 '\x0a'
berkeleydb-export database @0 'format=print\x0a'
berkeleydb-export database @0 'format=bytevalue\x0a'
tokyocabinet database @0 'ToKyO CaBiNeT\x0a' @24 '\x00\x00\x00\x00\x00\x00\x00\x00' @32 in[\x00-\x03]
kyotocabinet database @0 'KC\x0a\x00' @4 in[\x01-\x13] @5 in[\x01-\x13] @6 in[\x01-\x09] @8 in{'0','1','@','A'} @32 '\x00\x00' @40 '\x00\x00'
wiredtiger-block database @0 'A\xd8\x01\x00\x01\x00' @7 '\x00' @12 '\x00\x00\x00\x00'
wiredtiger-log database @0 'd\x10\x10\x00' @5 '\x00\x00\x00' @14 '\x00\x00'
tkrzw-tree database @0 'TDB\x00' @4 in[\x00-\x03] @34 in[\x00-\x01] @40 in[\x00-\x01]
tkrzw-hash database @0 'TkrzwHDB\x0a' @10 in[\x01-\x04] @16 '\x00\x00\x00' @24 '\x00\x00' @32 '\x00\x00' @40 '\x00\x00'
tkrzw-skip database @0 'TkrzwSDB\x0a' @10 in[\x01-\x04] @24 '\x00\x00' @32 '\x00\x00' @40 '\x00\x00'
tkrzw-queue database @0 'TkrzwMQX\x0a'
hsqldb-lck database @0 'HSQLLOCK'
hsqldb-script database @0 'SET DATABASE UNIQUE NAME '
hsqldb-properties database @0 '#HSQL Database Engine '
"""

# Signatures whose headers also have to fulfil a condition, SQL over the header h with u8(at), u16le(at), u32le(at), u32be(at)
# for its numbers, and what that adds to the confidence, a number or SQL.
RULED = (
    (r"jpeg image @0 '\xff\xd8\xff'", "true", 1),
    (r"webp image @0 'RIFF' @8 'WEBPVP8' @15 ' '", "length(h) >= 26 AND substring(h, 24, 3) = X'9d012a' AND u32le(4) - u32le(16) = 12 AND u32le(16) > 6", 381),
    (r"webp image @0 'RIFF' @8 'WEBPVP8' @15 'L'", "length(h) >= 26 AND u8(20) = 47 AND u32le(4) - u32le(16) = 12 AND u32le(16) > 6", 381),
    (r"webp image @0 'RIFF' @8 'WEBPVP8' @15 'X'", "length(h) >= 30 AND u32le(4) >= 18 AND u32le(16) = 10 AND u32le(20) < 64", 381),
    (r"mpeg-adts audio @0 '\xff' @1 in{'\xe2','\xe3','\xf2','\xf3','\xf4','\xf5','\xf6','\xf7','\xfa','\xfb','\xfc','\xfd','\xfe','\xff','\xf0','\xf1','\xf8','\xf9'}",
     "length(h) >= 4 AND CASE WHEN u8(1) IN (240, 241, 248, 249) THEN (u8(2) & 2) = 0 AND (shiftright(u8(2), 2) & 15) < 13 ELSE shiftright(u8(2), 4) NOT IN (0, 15) AND (u8(2) & 12) <> 12 END", 30),
    (r"ac3 audio @0 '\x0bw'", "length(h) >= 7 AND u8(4) < 192", 20),
    (r"ras image @0 'Y\xa6j\x95'", "length(h) < 24 OR substring(h, 21, 3) = X'000000' AND u8(23) < 6", "if(length(h) >= 24, 363, 1)"),
    (r"sgi-rgb image @0 '\x01\xda' @2 in[\x00-\x01] @3 in[\x01-\x02] @4 in{'\x00\x01','\x00\x02','\x00\x03'}", "length(h) >= 12 AND (u8(5) <> 3 OR u8(10) = 0 AND u8(11) BETWEEN 1 AND 5)", 10),
    (r"mpeg-video video @0 '\x00\x00\x01' @3 in{'\xb3','\xb0','\xb5'}", "u8(3) <> 176 OR substring(h, 6, 4) = X'000001b5'", 1),
    (r"vp8 video @3 '\x9d\x01*'", "length(h) >= 10 AND (u8(0) & 1) = 0 AND (shiftright(u8(0), 1) & 7) <= 3 AND (u8(0) & 16) <> 0 AND (u32le(0) & 16777184) <> 0 AND (u16le(6) & 16383) <> 0 AND (u16le(8) & 16383) <> 0", 150),
    (r"icns image @0 'icns'", "length(h) >= 8 AND u32be(4) >= 32", 2),
    (r"dcx image @0 '\xb1h\xde:'", "length(h) < 8 OR u32le(4) >= 12", 2),
    (r"gd image @0 '\xff' @1 in[\xfe-\xff]", "length(h) >= 7 AND substring(h, 3, 2) <> X'0000' AND substring(h, 5, 2) <> X'0000' AND (u8(6) = 1) = (u8(1) = 254) AND u8(6) < 2", 102),
    (r"fits image @0 'SIMPLE  = '", "length(h) >= 11 AND trim(split(decode(substring(h, 11, 70), 'ISO-8859-1'), '/')[0]) = 'T'", 180),
    (r"ps doc @0 '\xc5\xd0\xd3\xc6' @5 '\x00\x00\x00'", "u8(4) >= 30", 2),
    (r"winhelp doc @0 '?_\x03\x00' @6 '\x00\x00'", "true", "if(substring(h, 9, 4) = X'ffffffff', 400, 1)"),
    (r"latex doc @0 '\x5cdocumentclass'", "length(h) <= 14 OR NOT decode(substring(h, 15, 1), 'ISO-8859-1') rlike '[A-Za-z]'", 6),
    (r"latex-209 doc @0 '\x5cdocumentstyle'", "length(h) <= 14 OR NOT decode(substring(h, 15, 1), 'ISO-8859-1') rlike '[A-Za-z]'", 6),
    (r"lyx doc @0 '#LyX '", r"decode(h, 'ISO-8859-1') rlike '^[^\\n]*\\n\\\\lyxformat '", 1100),
    (r"zpaq archive @0 in{'7kS','zPQ'}", "CASE WHEN u8(0) = 55 THEN u8(3) = 116 ELSE u8(3) BETWEEN 1 AND 127 END", 52),
    (r"rifx media @0 in{'RIFX','XFIR'}", "length(h) >= 12 AND trim(decode(substring(h, 9, 4), 'ISO-8859-1')) rlike '^[A-Za-z0-9]+$'", 100),
    (r"appledouble other @0 '\x00\x05\x16\x07\x00'", "u8(5) <= 3", 25),
    (r"php other @0 '<?' @2 in{'p','P'} @6 in{'\x09','\x0a','\x0b','\x0c','\x0d',' '}", "lower(decode(substring(h, 1, 5), 'ISO-8859-1')) = '<?php'", 200),
    (r"lmdb-lock database @0 in{'\xbe\xef\xc0\xde','\xde\xc0\xef\xbe'}", "length(h) >= 8 AND CASE WHEN u8(0) = 190 THEN u8(7) ELSE u8(4) END BETWEEN 1 AND 4", 75),
    (r"exe code @0 'MZ'",
     "length(h) >= 64 AND u16le(2) <= 512 AND u32le(60) BETWEEN 64 AND 8166 AND (length(h) < u32le(60) + 4 OR substring(h, cast(u32le(60) + 1 as int), 4) IN (X'50450000', X'4c450000', X'4c580000') OR substring(h, cast(u32le(60) + 1 as int), 2) = X'4e45')",
     "326 + CASE substring(h, cast(u32le(60) + 1 as int), 4) WHEN X'50450000' THEN 400 WHEN X'4c450000' THEN 800 WHEN X'4c580000' THEN 800 ELSE if(substring(h, cast(u32le(60) + 1 as int), 2) = X'4e45', 263, 0) END + if(u16le(2) = 0 AND u16le(4) = 0, 400, 0)"),
    (r"xml other @0 '<?xml' @5 in{'\x09','\x0a','\x0b','\x0c','\x0d',' '}", "decode(h, 'ISO-8859-1') rlike '^<[?]xml[\\t-\\r ]+(version|encoding|standalone)=[\"\\']'",
     "100 * length(regexp_extract(decode(h, 'ISO-8859-1'), '^<[?]xml[\\t-\\r ]+((version|encoding|standalone)=[\"\\'])', 1)) - 9"),
    (r"xml-comment other @0 '<!--'", "true", 1),
    (r"mpeg-ts media @0 in{'\x00','G'}",
     "CASE WHEN u8(0) = 0 THEN length(h) >= 200 AND u8(4) = 71 AND u8(196) = 71 AND (u8(7) & 48) <> 0 AND (u8(5) & 128) = 0 AND (u8(199) & 48) <> 0 AND (u8(197) & 128) = 0 AND (u8(5) & 31) = 0 AND (u8(6) = 0 OR u8(6) BETWEEN 16 AND 32) ELSE length(h) >= 192 AND u8(188) = 71 AND (u8(3) & 48) <> 0 AND (u8(1) & 128) = 0 AND (length(h) < 380 OR u8(376) = 71) AND (u8(191) & 48) <> 0 AND (u8(189) & 128) = 0 AND ((u8(1) & 31) = 0 AND u8(2) = 0 OR (u8(1) & 31) = 31 AND u8(2) = 255 OR (u8(1) & 31) = 0 AND u8(2) BETWEEN 16 AND 32) END",
     301),
    (r"opentype font @0 in{'\x00\x01\x00\x00','OTTO'}", "length(h) >= 28 AND u8(4) = 0 AND u8(5) BETWEEN 1 AND 63 AND decode(substring(h, 13, 4), 'ISO-8859-1') rlike '^[A-Za-z0-9/ ]{4}$'", 400),
)
